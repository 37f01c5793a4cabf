"""Packing documents into sequences by length patterns and non-negative least squares.

Lengths are counted exactly; the histogram has at most as many rows as a
sequence has tokens, so it and the plan made from it stay the same size at any
corpus size. Patterns of few documents that fill a sequence are enumerated over
coarse length classes; non-negative least squares fits how often to repeat each
so that the histogram is used up. Of each count a share is held back, so that
what is left still has the short documents that close gaps; the rest is rounded
down. A pattern is repeated with exact lengths of its classes whose sum is the
sequence, so no pattern leaves a gap; where there are none, its documents go to
the residual, which is packed best-fit, longest first. How much to hold back
depends on the lengths: a few shares are tried, and the plan with the fewest
sequences is taken.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .store import materialize, rows_per_batch
from .tokens import END, WordEncoder, chunks, column_bytes
from .workers import TEXTS_PER_BATCH, map_arrow

#: Length classes of a sequence, and most documents in a pattern.
CLASSES, PARTS = 64, 4
#: Shares of the patterns' counts that may be left to the residual.
HELD_BACK = (1 / 8, 1 / 2, 7 / 8, 31 / 32, 255 / 256)


@lru_cache(maxsize=8)
def patterns(total: int = CLASSES, parts: int = PARTS) -> np.ndarray:
    """Column per pattern: how many documents of each class 1..total it takes; the classes sum to ``total``."""
    found: list[tuple[int, ...]] = []

    def extend(prefix: tuple[int, ...], left: int) -> None:
        if not left:
            found.append(prefix)
        elif len(prefix) < parts:
            for c in range(min(left, prefix[-1] if prefix else total), 0, -1):
                extend((*prefix, c), left - c)

    extend((), total)
    out = np.zeros((total, len(found)))
    for k, pattern in enumerate(found):
        for c in pattern:
            out[c - 1, k] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method (Lawson and Hanson 1974)."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        k = int(slope.argmax())
        if slope[k] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active[k] = True
        while True:
            trial = np.zeros_like(x)
            trial[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if trial[active].min() > 1e-12:
                x = trial
                break
            falling = active & (trial <= 1e-12)
            step = np.min(x[falling] / np.maximum(x[falling] - trial[falling], 1e-300))
            x = x + step * (trial - x)
            drop = active & (x <= 1e-12)
            if not drop.any():
                drop = falling
            x[drop], active[drop] = 0, False
            if not active.any():
                break
    return x


def class_edges(size: int) -> np.ndarray:
    """Bounds of the length classes: class c holds the lengths above edges[c - 1] up to edges[c]."""
    return np.linspace(0, size, min(CLASSES, size) + 1).round().astype(np.int64)


class Plan:
    """Segments (length, first rank, documents, first sequence, offset) that place all documents of a histogram.

    Documents of one length are told apart by their rank; a segment puts those
    of consecutive ranks into as many consecutive sequences at the same offset.
    """

    def __init__(self, histogram: np.ndarray, shapes: np.ndarray, fitted: np.ndarray):
        self.size = len(histogram) - 1
        self.left = histogram.astype(np.int64).copy()
        self.rank = np.zeros(len(histogram), np.int64)
        self.sequences = 0
        self.segments: list[tuple[int, int, int, int, int]] = []
        #: gap -> (first sequence, sequences) of that gap; the gaps in order.
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.order: list[int] = []
        self.edges = class_edges(self.size)
        self._repeat_patterns(shapes, np.floor(fitted).astype(np.int64))
        self._best_fit()

    def _place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.segments.append((length, int(self.rank[length]), count, sequence, offset))
        self.rank[length] += count
        self.left[length] -= count

    def _open(self, gap: int, sequence: int, count: int) -> None:
        if gap not in self.gaps:
            self.gaps[gap] = []
            insort(self.order, gap)
        self.gaps[gap].append((sequence, count))

    def _longest(self, at_most: int) -> int:
        """The greatest length up to it of which documents are left, or 0."""
        found = np.flatnonzero(self.left[: at_most + 1])
        return int(found[-1]) if len(found) else 0

    def _repeat_patterns(self, shapes: np.ndarray, fitted: np.ndarray) -> None:
        for k in np.argsort(-fitted, kind="stable")[: np.count_nonzero(fitted)]:
            times = int(fitted[k])
            own = [int(c) + 1 for c in np.flatnonzero(shapes[:, k])[::-1] for _ in range(int(shapes[c, k]))]
            while times and (lengths := self._exact(own, self.size)):
                many = min([times, *(int(self.left[n]) // lengths.count(n) for n in lengths)])
                offset = 0
                for n in lengths:
                    self._place(n, many, self.sequences, offset)
                    offset += n
                self.sequences += many
                times -= many

    def _exact(self, classes: list[int], total: int) -> list[int]:
        """Lengths of these classes, of which documents are left, with that sum; empty if there are none.

        The last one follows from the others, and may be of a neighbouring class.
        """
        low, high = self.edges[classes[0] - 1] + 1, self.edges[classes[0]]
        if len(classes) == 1:
            return [total] if 0 < total <= self.size and self.left[total] > 0 else []
        own = np.arange(low, min(high, total - 1) + 1)
        if len(classes) == 2:
            pair = np.minimum(self.left[own], self.left[total - own])
            pair[2 * own == total] //= 2
            if not len(pair) or not pair.max():
                return []
            n = int(own[pair.argmax()])
            return [n, total - n]
        for n in own[self.left[own] > 0][::-1].tolist():
            self.left[n] -= 1
            found = self._exact(classes[1:], total - n)
            self.left[n] += 1
            if found:
                return [n, *found]
        return []

    def _best_fit(self) -> None:
        length = self._longest(self.size)
        while length:
            count = int(self.left[length])
            at = bisect_left(self.order, length)
            if at == len(self.order):
                # No gap is long enough: as many new sequences as are filled by this length alone.
                many = -(-count // (self.size // length))
                self._open(self.size, self.sequences, many)
                self.sequences += many
                continue
            gap = self.order[at]
            sequence, many = self.gaps[gap].pop()
            if not self.gaps[gap]:
                del self.gaps[gap], self.order[at]
            now = min(count, many)
            self._place(length, now, sequence, self.size - gap)
            if many > now:
                self._open(gap, sequence + now, many - now)
            if gap > length:
                self._open(gap - length, sequence, now)
            length = self._longest(length)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted keys length << 40 | first rank, sequence of rank 0, offset)."""
        found = np.asarray(self.segments, np.int64).reshape(-1, 5)
        key = (found[:, 0] << 40) | found[:, 1]
        order = np.argsort(key)
        return key[order], (found[:, 3] - found[:, 1])[order], found[order, 4]


def plan(histogram: np.ndarray) -> Plan:
    """Plan of the fewest sequences among those of the shares held back; of equal ones that with most patterns."""
    edges = class_edges(len(histogram) - 1)
    shapes = patterns(len(edges) - 1)
    fitted = nnls(shapes, np.diff(np.cumsum(histogram)[edges]).astype(float))
    return min((Plan(histogram, shapes, fitted * (1 - share)) for share in HELD_BACK), key=lambda p: p.sequences)


def _pieces(path: str, size: int, end_id: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "nth"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path, end_id)
        chunk = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            texts, ids = column_bytes(batch, "text"), batch.column(0).to_pylist()
            rows: list[tuple] = []
            for begin, end in chunks(texts):
                words, bounds = [], []
                for text in texts[begin:end]:
                    words += text.split() if text else ()
                    words.append(END)
                    bounds.append(len(words))
                flat, count = encoder.tokens(encoder.look_up(words))
                stops = np.cumsum(count)[np.asarray(bounds) - 1].tolist()
                tokens = memoryview(np.ascontiguousarray(flat[0].astype("<u4"))).cast("B")
                start = 0
                for doc_id, stop in zip(ids[begin:end], stops):
                    for k, at in enumerate(range(start, stop, size)):
                        n = min(size, stop - at)
                        rows.append((doc_id, k, at - start, n, crc32(tokens[4 * at : 4 * (at + n)]), chunk, int(seen[n])))
                        seen[n] += 1
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names)

    return run


def _placed(key: np.ndarray, base: np.ndarray, offset: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (length << 40) | rank, "right") - 1
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(base[at] + rank), pa.array(offset[at])], [*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of all documents in sequences of at most ``size`` tokens; a row for each piece of a document.

    A document is its text's ids and ``end_id``; only longer ones are cut. A
    null text is an empty one: ``end_id`` alone. Repeated rows, null ids too,
    are documents of their own; an empty table gives an empty result. Other
    columns of ``docs`` take no part. ``tokenizer`` is the vocabulary file's
    path, the same on each machine.
    """
    if not 1 <= size < 1 << 22:
        raise ValueError("size must be from 1 to 4194303")
    skinny = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    pieces = map_arrow(skinny, _pieces(tokenizer, size, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, nth long")
    with rows_per_batch(docs.sparkSession, TEXTS_PER_BATCH):
        pieces = materialize(pieces, "pack-pieces")
    counts = materialize(pieces.groupBy("chunk", "length").agg(F.count("*").alias("n")), "pack-counts")
    histogram = np.zeros(size + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most ``size`` rows
        histogram[length] = n
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # By sort and merge: the table of counts grows with the number of partitions.
    ranked = pieces.join(first.hint("merge"), ["chunk", "length"]).select(*names, (F.col("before") + F.col("nth")).alias("rank"))
    return map_arrow(ranked, _placed(*plan(histogram).arrays(), names), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
