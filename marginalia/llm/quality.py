"""Quality rules: gradient-boosted trees over document statistics.

A few base rules reject outright. The rest is judged by boosted trees, fitted
on a bounded sample of labelled documents, with monotonic constraints on
features of which more is never better. The trees are complete binary trees in
flat numpy arrays, walked for all documents of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import column, numbered, schema_of
from .tokens import chunks, column_bytes
from .workers import map_arrow

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_STOPS = b".!?"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Feature -> +1 (more is never worse), -1 (more is never better) or 0.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0,
    "upper_share": -1, "digit_share": -1, "stops_per_word": 0, "exclaims_per_word": -1, "bars_per_word": -1, "words_per_line": 0, "top_word_share": -1,
}
#: Words of a window that counts as repeated if it comes again.
WINDOW = 5
#: Labelled documents that a model is fitted on at most.
MAX_LABELLED = 20_000


def _window_keys(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A number for each window of WINDOW ids, the same for the same ids in the same document and for no others."""
    m, many = len(ids) - WINDOW + 1, int(ids.max()) + 1
    key, most = doc[:m].astype(np.int64), int(doc[-1]) + 1
    for k in range(WINDOW):
        if most * many >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            most = int(key.max()) + 1
        key = key * many + ids[k : k + m]
        most *= many
    return key


def statistics(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, features) with a row for each text; null is an empty text."""
    n = len(texts)
    base, extra = np.zeros((n, len(BASE)), np.int64), np.zeros((n, 8))
    words: list[bytes] = []
    for i, text in enumerate(texts):
        own = text.split() if text else []
        if not own:
            continue
        words += own
        lines = [line for line in text.split(b"\n") if line.strip()]
        chars = len(text.decode()) - sum(map(text.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
        base[i, :4] = len(own), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines))
        extra[i, :6] = len(lines), *(len(text) - len(text.translate(None, c)) for c in (_UPPER, _DIGITS, _STOPS)), text.count(b"!"), text.count(b"|")
    counts = base[:, 0]
    doc = np.repeat(np.arange(n), counts)
    ids = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    if len(words) >= WINDOW:
        at = np.flatnonzero(doc[: len(words) - WINDOW + 1] == doc[WINDOW - 1 :])
        _, back, times = np.unique(_window_keys(ids, doc)[at], return_inverse=True, return_counts=True)
        again = at[times[back] > 1]
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + WINDOW, -1)
        base[:, 4] = np.bincount(doc[np.cumsum(edge)[:-1] > 0], minlength=n)
    if len(words):
        single, times = np.unique(doc * (ids.max() + 1) + ids, return_counts=True, return_index=True)[1:]
        extra[:, 6] = np.bincount(doc[single], minlength=n)
        np.maximum.at(extra[:, 7], doc[single], times)
    per_word, per_char = np.maximum(counts, 1), np.maximum(base[:, 1], 1)
    lines = np.maximum(extra[:, 0], 1)
    features = np.stack(
        [
            np.log1p(counts), base[:, 1] / per_word, base[:, 2] / per_word, base[:, 3] / lines, base[:, 4] / per_word, extra[:, 6] / per_word,
            extra[:, 1] / per_char, extra[:, 2] / per_char, extra[:, 3] / per_word, extra[:, 4] / per_word, extra[:, 5] / per_word, counts / lines, extra[:, 7] / per_word,
        ],
        1,
    )
    return base, features


class BoostedTrees:
    """Logistic boosting over binned features with monotonic constraints; ``sign`` is +1, -1 or 0 by feature."""

    def __init__(self, sign: list[int], trees: int = 100, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 8, ridge: float = 1.0):
        self.sign, self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = np.asarray(sign), trees, depth, rate, bins, least, ridge
        self.bias = 0.0
        nodes = 2 ** (depth + 1) - 1
        #: Node arrays: children of i are 2i+1 and 2i+2; a node without a split sends all to the left.
        self.feature, self.threshold = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf)
        self.value = np.zeros((trees, nodes))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if n else 0.5
        self.bias = float(np.log(share / (1 - share)))
        if not n or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        raw = np.full(n, self.bias)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            raw += self._grow(t, binned, edges, p - y, np.maximum(p * (1 - p), 1e-9))
        return self

    def _grow(self, t: int, binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        n, width = binned.shape
        node = np.zeros(n, np.int64)
        low, high = np.full(2 ** (self.depth + 1) - 1, -np.inf), np.full(2 ** (self.depth + 1) - 1, np.inf)
        for level in range(self.depth):
            first, many = 2**level - 1, 2**level
            best = np.full(many, 1e-6)
            split = {}
            for f in range(width):
                if not len(edges[f]):
                    continue
                cells = self.bins + 1
                at = (node - first) * cells + binned[:, f]
                g, h, c = (np.bincount(at, w, many * cells).reshape(many, cells).cumsum(1) for w in (grad, hess, None))
                lo, hi = low[first : first + many, None], high[first : first + many, None]
                left = np.clip(-g / (h + self.ridge), lo, hi)
                rg, rh, rc = g[:, -1:] - g, h[:, -1:] - h, c[:, -1:] - c
                right = np.clip(-rg / (rh + self.ridge), lo, hi)
                whole = np.clip(-g[:, -1:] / (h[:, -1:] + self.ridge), lo, hi)
                gain = self._gain(g, h, left) + self._gain(rg, rh, right) - self._gain(g[:, -1:], h[:, -1:], whole)
                bad = (c < self.least) | (rc < self.least) | ((right - left) * self.sign[f] < 0)
                bad[:, len(edges[f]) :] = True
                gain[bad] = -np.inf
                k = gain.argmax(1)
                for j in np.flatnonzero(gain[np.arange(many), k] > best):
                    best[j] = gain[j, k[j]]
                    split[j] = (f, int(k[j]), left[j, k[j]], right[j, k[j]])
            go = np.zeros(n, np.int64)
            for j, (f, k, left, right) in split.items():
                i = first + j
                self.feature[t, i], self.threshold[t, i] = f, edges[f][k]
                mid = (left + right) / 2
                for child in (2 * i + 1, 2 * i + 2):
                    low[child], high[child] = low[i], high[i]
                if self.sign[f]:
                    below, above = (2 * i + 1, 2 * i + 2) if self.sign[f] > 0 else (2 * i + 2, 2 * i + 1)
                    high[below], low[above] = min(high[below], mid), max(low[above], mid)
                own = node == i
                go[own] = binned[own, f] > k
            for j in range(many):
                if j not in split:
                    low[2 * (first + j) + 1], high[2 * (first + j) + 1] = low[first + j], high[first + j]
            node = 2 * node + 1 + go
        size = 2 ** (self.depth + 1) - 1
        g, h = np.bincount(node, grad, size), np.bincount(node, hess, size)
        self.value[t] = self.rate * np.clip(-g / (h + self.ridge), low, high)
        return self.value[t, node]

    def _gain(self, g: np.ndarray, h: np.ndarray, value: np.ndarray) -> np.ndarray:
        return -(g * value + 0.5 * (h + self.ridge) * value**2)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the label 1."""
        raw, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += value[node]
        return 1 / (1 + np.exp(-raw))


def base_failed(base: np.ndarray) -> np.ndarray:
    """Fewer than 10 words, or more than 20 % of the words in repeated windows."""
    return (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = column_bytes(batch, "text")
        found = [statistics(texts[b:e])[1] for b, e in chunks(texts)]
        flat = np.concatenate(found) if found else np.zeros((0, len(FEATURES)))
        rows = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, len(FEATURES), dtype=np.int32), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], ["doc_id", "label", "features"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> BoostedTrees:
    """Trees fitted on at most ``max_labelled`` labelled documents, chosen by a hash of their ids.

    Null ids and labels take no part; an id labelled twice counts as its lowest
    label. Without labelled documents, or with one label only, the model gives
    every document that label's (or no label's, 0.5) probability.
    """
    spark = docs.sparkSession
    chosen = labels.select(column(id_col).cast("long").alias("of"), column(label_col).cast("int").alias("label")).dropna()
    chosen = chosen.groupBy("of").agg(F.min("label").alias("label")).orderBy(F.xxhash64("of"), "of").limit(max_labelled)
    chosen = spark.createDataFrame(chosen.toPandas(), "of long, label int")  # bounded: at most max_labelled rows
    texts = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("doc_id", "label", "text")
    rows = map_arrow(joined, _featurize, "doc_id long, label int, features array<double>")
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(max_labelled).toPandas()
    x = np.stack(sample["features"].to_list()) if len(sample) else np.zeros((0, len(FEATURES)))
    return BoostedTrees(list(FEATURES.values())).fit(x, sample["label"].to_numpy(float))


#: Columns of :func:`judge_quality`'s result.
ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def _judge(model: BoostedTrees, threshold: float, columns: list[str], filtering: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column_bytes(batch, "text")
            found = [statistics(texts[b:e]) for b, e in chunks(texts)]
            base = np.concatenate([f[0] for f in found]) if found else np.zeros((0, len(BASE)), np.int64)
            x = np.concatenate([f[1] for f in found]) if found else np.zeros((0, len(FEATURES)))
            score, failed = model.score(x), base_failed(base)
            kept = ~failed & (score >= threshold)
            own = [batch.column(i) for i in range(len(columns))]
            if filtering:
                yield pa.RecordBatch.from_arrays(own, columns).filter(pa.array(kept))
            else:
                added = [*(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(failed), pa.array(kept), pa.array(score)]
                yield pa.RecordBatch.from_arrays([*own, *added], [*columns, *(c.split()[0] for c in ADDED.split(", "))])

    return run


def judge_quality(docs: DataFrame, model: BoostedTrees, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The ``carry`` columns of every row of ``docs``, its base counts, base_failed, kept and score.

    Empty and null texts have no words and so fail the base rules; repeated rows
    are judged one by one; an empty table gives an empty result. Other columns
    take no part; carried ones may have any name but those of the result.
    """
    rows = docs.select(*numbered(list(carry)), column(text_col).alias("text"))
    return map_arrow(rows, _judge(model, threshold, list(carry), False), schema_of(docs, list(carry), ADDED))


def keep_quality(docs: DataFrame, model: BoostedTrees, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names; rows as :func:`judge_quality` takes them."""
    rows = docs.select(*numbered(docs.columns), column(text_col).alias("text"))
    return map_arrow(rows, _judge(model, threshold, docs.columns, True), schema_of(docs, docs.columns))
