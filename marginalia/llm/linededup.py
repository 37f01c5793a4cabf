"""Repeated runs of lines, found by winnowing over line hashes.

A window is the shortest run of lines from some line on that has at least
``min_words`` words; the line with the smallest hash in it is selected
(winnowing: Schleimer, Wilkerson and Aiken, 2003). Two documents that share a
run of that many words share a whole window, and both select the same line of
it. Each selected line is one fingerprint, however many windows selected it; it
carries these windows' hashes and the hashes of the lines around. Fingerprints
that occur at one position only end here, which is most of them.

Of the others, positions meet by fingerprint, and the hashes of its windows tell
which matches are real. A match is extended line by line: a window and the next
lines, one more each time, are keys of their own, each with the first position
at which it occurs, so that every earlier position counts, not only the
window's first. To the left the next window takes over, as a run that begins
earlier has a window that begins there; to the right lines with fewer words
than a window are followed. What lies at the later position is deleted; where a
run overlaps its own first occurrence, that occurrence stays whole.

Positions are met by aggregation (the smallest one of each key), never by
pairs, so a passage that very many documents share costs a few rows for each,
and the rows of such a passage are joined where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .frames import column, join_counted, numbered, schema_of
from .store import materialize, rows_per_batch, scratch
from .tokens import column_bytes
from .workers import TEXTS_PER_BATCH, map_arrow

FINGERPRINTS = "doc_id long, text_hash long, fp long, fp_at int, low int, starts array<int>, stops array<int>, k1 array<long>, k2 array<long>, lines array<long>"


def lines_with_words(text: bytes) -> tuple[list[bytes], list[int]]:
    """(all \\n-split lines, places of those with a word)."""
    lines = text.split(b"\n")
    return lines, [i for i, line in enumerate(lines) if line.strip()]


def _selected(text: bytes, min_words: int) -> Iterator[tuple]:
    """(fp, place, first line carried, windows' starts, stops and hashes, hashes of the lines carried) of each fingerprint."""
    lines, at = lines_with_words(text)
    if not at:
        return
    upto = np.cumsum([0, *(len(lines[i].split()) for i in at)])
    if upto[-1] < min_words:
        return
    digest = [xxhash.xxh3_128_digest(lines[i].strip()) for i in at]
    value = np.frombuffer(b"".join(digest), "<i8")[::2]
    stops = np.searchsorted(upto, upto[:-1] + min_words)  # window i: lines i .. stops[i] - 1
    stops = stops[stops <= len(at)]
    # Lines that follow, with fewer words than a window: longer runs are windows of their own.
    right = (np.searchsorted(upto, upto[stops] + min_words) - 1).tolist()
    held = value.tolist()
    windows: dict[int, list[int]] = {}
    for i, stop in enumerate(stops.tolist()):
        best = stop - 1
        for k in range(stop - 2, i - 1, -1):
            if held[k] < held[best]:
                best = k
        windows.setdefault(best, []).append(i)
    for fp, own in windows.items():
        ends = stops[own].tolist()
        keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b"".join(digest[i:stop])) for i, stop in zip(own, ends)), "<i8").reshape(-1, 2)
        low = own[0]
        yield held[fp], fp, low, own, ends, keys[:, 0], keys[:, 1], value[low : max(ends[-1], right[own[-1]])]


def _lists(parts: list, of: pa.DataType) -> pa.ListArray:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.concatenate(parts) if len(parts) else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.astype(of.to_pandas_dtype()), of))


def _fingerprints(min_words: int):
    names = [c.split()[0] for c in FINGERPRINTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column_bytes(batch, "text")):
                if text:
                    rows += [(doc_id, text_hash, *found) for found in _selected(text, min_words)]
            parts = list(zip(*rows)) if rows else [[]] * len(names)
            plain = [pa.array(c, t) for c, t in zip(parts, types)]
            yield pa.RecordBatch.from_arrays([*plain, *(_lists(c, t) for c, t in zip(parts[5:], (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())))], names)

    return run


def fingerprints(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """A row for each selected line of each of ``docs`` (doc_id, text_hash, text)."""
    return map_arrow(docs.select("doc_id", "text_hash", "text"), _fingerprints(min_words), FINGERPRINTS)


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, text_hash, runs): for documents with later repeated runs, arrays of (first, last) places among lines with words.

    ``docs`` has doc_id, text_hash, text. Positions are ordered by doc_id, null
    last, then text_hash, then line; rows with one id and text are one document.
    """
    with rows_per_batch(docs.sparkSession, TEXTS_PER_BATCH):
        found = materialize(fingerprints(docs, min_words), "line-fingerprints")
    place = F.xxhash64("doc_id", "text_hash", "fp_at")
    shared = found.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a < b").select("fp", "n")
    met = join_counted(found, materialize(shared, "line-shared"), ["fp"], found.count(), "left_semi")
    each = F.inline(F.arrays_zip("starts", "stops", "k1", "k2")).alias("start", "stop", "k1", "k2")
    # Of each window and the lines after it: 0, then a hash of one line more each time.
    further = F.aggregate(
        F.slice("lines", F.col("stop") - F.col("low") + 1, F.size("lines")), F.array(F.lit(0).cast("long")), lambda upto, line: F.concat(upto, F.array(F.xxhash64(F.element_at(upto, -1), line)))
    )
    windows = met.select("doc_id", "text_hash", "low", "lines", each).select(
        F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "start").alias("at"), (F.col("stop") - F.col("start")).alias("size"), "k1", "k2", further.alias("further")
    )
    windows = materialize(windows, "line-windows")
    keys = ["k1", "k2", "upto"]
    runs = windows.select("at", "size", "k1", "k2", F.posexplode("further").alias("more", "upto"))
    first = runs.groupBy(*keys).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    total = windows.agg(F.coalesce(F.sum(F.size("further")), F.lit(0))).first()[0]
    later = join_counted(runs, materialize(first, "line-first"), keys, total).where(F.col("at") > F.col("first"))
    size = F.col("size") + F.col("more")
    own = F.col("at.doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at.text_hash") == F.col("first.text_hash"))
    begin = F.when(own, F.greatest(F.col("at.start"), F.col("first.start") + size)).otherwise(F.col("at.start"))
    cut = later.select("at.doc_id", "at.text_hash", begin.alias("first"), (F.col("at.start") + size - 1).alias("last"))
    cut = cut.groupBy("doc_id", "text_hash", "first").agg(F.max("last").alias("last"))
    return cut.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def _cut(columns: int, text_at: int, names: list[str], filtering: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, totals, removed, left = [], [], [], []
            for text, runs in zip(column_bytes(batch, f"c{text_at}"), batch.column(columns).to_pylist()):
                lines, at = lines_with_words(text) if text else ([], [])
                totals.append(len(at))
                gone: set[int] = set()
                for r in runs or ():
                    gone.update(at[r["first"] : r["last"] + 1])
                removed.append(len(gone))
                if gone:
                    text = b"\n".join(line for i, line in enumerate(lines) if i not in gone)
                texts.append(text)
                left.append(not gone or len(gone) < len(at))
            own = [pa.array(texts, pa.binary()).cast(pa.string()) if i == text_at else batch.column(i) for i in range(columns)]
            if filtering:
                yield pa.RecordBatch.from_arrays(own, names).filter(pa.array(left, pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([*own, pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], names)

    return run


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from the text, n_lines (with a word, before) and n_removed.

    A run of ``min_words`` words or more goes where it occurs at any earlier
    position; where it overlaps its first occurrence, only the lines after that
    go. Lines are compared without white space at
    their ends; lines without a word stay and break no run. Null and empty texts
    are unchanged. Rows with one id and one text are one document and get one
    result; ids may be null, those documents come last. An empty table gives an
    empty result; input columns called n_lines or n_removed are replaced, any
    other name is kept.
    """
    return _deduplicated(docs, [c for c in docs.columns if c not in ("n_lines", "n_removed")], min_words, id_col, text_col, False)


def drop_repeated_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with texts as :func:`dedup_lines` cuts them, all columns as they were; rows of whose lines with a word none is left go."""
    return _deduplicated(docs, docs.columns, min_words, id_col, text_col, True)


def _deduplicated(docs: DataFrame, columns: list[str], min_words: int, id_col: str, text_col: str, filtering: bool) -> DataFrame:
    text = column(text_col)
    # Rows without a text have no runs: a hash of their own keeps them from being one key.
    own = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(text))
    keyed = docs.select(*numbered(columns), column(id_col).cast("long").alias("doc_id"), own.alias("text_hash"))
    with scratch(docs.sparkSession):
        slim = docs.select(column(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
        runs = materialize(repeated_runs(slim, min_words), "line-runs", keep=True)
    runs = runs.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "runs")
    # Texts are dealt out by a sort-merge join at every size: the runs grow with the corpus.
    joined = keyed.join(runs.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left").select(*[f"c{i}" for i in range(len(columns))], "runs")
    schema = schema_of(docs, columns, "" if filtering else "n_lines long, n_removed long")
    return map_arrow(joined, _cut(len(columns), columns.index(text_col), schema.names, filtering), schema)
