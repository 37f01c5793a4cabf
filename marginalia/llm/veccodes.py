"""Compression of vectors to codes: Lloyd rounds with Elkan's bounds.

(Elkan, "Using the Triangle Inequality to Accelerate k-Means", 2003.) Vectors
are cut into equal parts, each with a codebook of its own. Beside each vector
a table keeps, for each part, an upper bound of the distance to its entry and a
lower bound of the distance to every entry. A round moves the bounds by what
the entries moved, leaves entries out that the triangle inequality rules out
strictly, and settles all others by whole-number squared distances, so that
ties are decided as without bounds. Bounds are stored a hair too wide, which
rounding cannot cross.

Each pass writes the table of the next round to the shared folder, together
with each task's sums for each entry; only those sums are added up, and only
the codebooks come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from .frames import column, join_counted
from .store import discard, materialize, table_path
from .topk import usable
from .workers import map_arrow

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Relative slack of bounds that are stored as 32-bit numbers.
SLACK = 2.0**-20
#: Scaled components beyond are held there, so that sums stay exact.
MOST = 2**90
_LONG = 2**63 - 1


def scaled(values: pa.Array, width: int, wide: bool) -> np.ndarray:
    """floor(SCALE * x) of list values, rows of ``width``; short vectors end in zeros. ``wide``: as Python's integers."""
    flat = np.floor(SCALE * values.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    size = np.diff(values.offsets.to_numpy())
    if wide:
        whole = np.empty(len(flat), object)
        whole[:] = [max(-MOST, min(MOST, int(x))) if np.isfinite(x) else (MOST if x > 0 else -MOST) for x in flat]
        out = np.zeros((len(size), width), object)
    else:
        whole, out = flat.astype(np.int64), np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = whole
    return out


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, whole numbers."""
    return ((x - y) ** 2).sum(-1)


def _root(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64))


@dataclass
class Bounds:
    """Codes of n parts, bounds of their distances, and how many distances were computed for them."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    looked: int = 0


def first_codes(x: np.ndarray, book: np.ndarray) -> Bounds:
    """All distances of n parts to the entries of their codebook."""
    square = np.stack([squares(x, entry) for entry in book], 1)
    code = square.argmin(1) if len(x) else np.zeros(0, np.int64)  # the lower index among equals
    root = _root(square)
    return Bounds(code, root[np.arange(len(x)), code] * (1 + SLACK), root * (1 - SLACK), square.size)


def next_codes(x: np.ndarray, book: np.ndarray, held: Bounds, moved: np.ndarray) -> Bounds:
    """Codes after the entries of a codebook have moved that far, by as few distances as the bounds leave."""
    code = held.code.copy()
    upper = (held.upper + moved[code]) * (1 + SLACK)
    lower = np.maximum(held.lower - moved, 0) * (1 - SLACK)
    half = _root(squares(book[:, None], book[None])) / 2 * (1 - SLACK)
    np.fill_diagonal(half, np.inf)
    ask = np.flatnonzero(upper >= half.min(1)[code])
    open_ = (lower[ask] <= upper[ask, None]) & (half[code[ask]] <= upper[ask, None])
    ask = ask[open_.any(1)]
    best = squares(x[ask], book[code[ask]])  # the bound made tight before any other distance
    own = _root(best)
    upper[ask], lower[ask, code[ask]] = own * (1 + SLACK), own * (1 - SLACK)
    looked = len(ask)
    for j in range(len(book) if len(ask) else 0):
        at = np.flatnonzero((lower[ask, j] <= upper[ask]) & (half[code[ask], j] <= upper[ask]))
        if not len(at):
            continue
        rows = ask[at]
        square = squares(x[rows], book[j])
        looked += len(at)
        root = _root(square)
        lower[rows, j] = root * (1 - SLACK)
        nearer = (square < best[at]) | ((square == best[at]) & (j < code[rows]))
        at, rows = at[nearer], rows[nearer]
        best[at], code[rows], upper[rows] = square[nearer], j, root[nearer] * (1 + SLACK)
    return Bounds(code, upper, lower, looked)


@dataclass(frozen=True)
class _Pass:
    """One assignment of all vectors to the entries of ``books`` (parts x entries x components)."""

    books: np.ndarray
    moved: np.ndarray | None
    wide: bool
    last: bool

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = self.books.shape
        count, total, looked = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), self.books.dtype), 0
        schema = None
        for batch in batches:
            n, schema = batch.num_rows, batch.schema
            x = scaled(batch.column(2), parts * width, self.wide).reshape(n, parts, width)
            if self.moved is not None:
                codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                uppers = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<f4").reshape(n, parts).astype(np.float64)
                lowers = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<f4").reshape(n, parts, entries).astype(np.float64)
            found = []
            for p, book in enumerate(self.books):
                if self.moved is None:
                    own = first_codes(x[:, p], book)
                else:
                    own = next_codes(x[:, p], book, Bounds(codes[:, p], uppers[:, p], lowers[:, p]), self.moved[p])
                looked += own.looked
                found.append(own)
                if not self.last:
                    count[p] += np.bincount(own.code, minlength=entries)
                    np.add.at(total[p], own.code, x[:, p])
            code = np.stack([own.code for own in found], 1)
            ids, label, vector = (batch.column(k) for k in range(3))
            if self.last:
                error = sum(squares(x[:, p], book[code[:, p]]) for p, book in enumerate(self.books))
                yield pa.RecordBatch.from_arrays([ids, label, pa.array(["".join(f"{c:02x}" for c in own) for own in code.tolist()]), pa.array([min(int(e), _LONG) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])
                continue
            upper = np.stack([own.upper for own in found], 1) * (1 + SLACK)
            lower = np.stack([own.lower for own in found], 1) * (1 - SLACK)
            rows = [[r.astype(kind).tobytes() for r in v] for v, kind in ((code, np.uint8), (upper, "<f4"), (lower, "<f4"))]
            yield self._batch(schema, n, [ids, label, vector, *(pa.array(r, pa.binary()) for r in rows)], None)
        if schema is not None and not self.last:
            place = [(p, e) for p in range(parts) for e in range(entries)]
            sums = [
                pa.array([p for p, _ in place], pa.int32()), pa.array([e for _, e in place], pa.int32()), pa.array(count.ravel()),
                pa.array([[str(v) for v in total[p, e].tolist()] for p, e in place], pa.list_(pa.string())), pa.array([looked] + [0] * (len(place) - 1), pa.int64()),
            ]
            yield self._batch(schema, len(place), None, sums)

    def _batch(self, schema: pa.Schema, n: int, rows: list | None, sums: list | None) -> pa.RecordBatch:
        """Rows of vectors, or rows of sums, with nulls in the others' columns."""
        kinds = [schema.types[0], schema.types[1], schema.types[2], pa.binary(), pa.binary(), pa.binary()]
        more = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int64()]
        arrays = (rows or [pa.nulls(n, t) for t in kinds]) + (sums or [pa.nulls(n, t) for t in more])
        return pa.RecordBatch.from_arrays(arrays, ["vec_id", "label", "vector", "code", "upper", "lower", "part", "entry", "n", "total", "looked"])


def _moved_books(table: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(new books, how far each entry moved, distances computed) from the sums of a pass; at most parts x entries rows are collected."""
    sums = table.where("part is not null").select("part", "entry", "n", "looked", F.posexplode("total").alias("at", "v")).groupBy("part", "entry", "at")
    sums = sums.agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("looked").alias("looked"))
    new, looked = books.copy(), 0
    for r in sums.collect():
        looked += r.looked if r["at"] == 0 else 0
        if r.n:
            new[r.part, r.entry, r["at"]] = int(r.v) // r.n
    return new, _root(squares(new, books)) * (1 + SLACK), looked


def _codebooks(spark: SparkSession, kept: DataFrame, parts: int, entries: int, rounds: int, looked: list) -> tuple[DataFrame, np.ndarray] | None:
    size = kept.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))).first()
    if size[0] is None:
        return None
    width = -(-max(1, size[0]) // parts)
    wide = width * (2 * (SCALE * (size[1] or 0.0) + 1)) ** 2 >= 2.0**62
    least = kept.select("vec_id", F.transform("vector", lambda x: x.cast("double")).alias("v")).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = scaled(pa.array([r.v for r in least], pa.list_(pa.float64())), parts * width, wide).reshape(len(least), parts, width).swapaxes(0, 1).copy()
    fields = [StructField(f.name, f.dataType, True) for f in kept.schema.fields]
    table_of = StructType([*fields, *StructType.fromDDL("code binary, upper binary, lower binary, part int, entry int, n long, total array<string>, looked long").fields])
    rows, moved, before = kept, None, None
    for _ in range(rounds):
        path = table_path(spark, "codes")
        map_arrow(rows, _Pass(books, moved, wide, last=False), table_of).write.parquet(path)
        if before:
            discard(spark, before)
        before = path
        table = spark.read.schema(table_of).parquet(path)
        rows = table.where("part is null").select("vec_id", "label", "vector", "code", "upper", "lower")
        books, moved, n = _moved_books(table, books)
        looked.append(n)
        if not moved.any():
            break  # all further rounds are this one
    out_of = StructType([*fields[:2], *StructType.fromDDL("code string, error long").fields])
    out = materialize(map_arrow(rows, _Pass(books, moved, wide, last=True), out_of), "codes-last")
    if before:
        discard(spark, before)
    return out, books


def compress_vectors(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", looked: list | None = None
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every usable row of ``vectors``.

    Components become floor(4096 x), held at 2^90 on either side; vectors that
    are null or hold null or non-finite components are dropped. Parts are equal
    slices of the longest vector's length, rounded up to a multiple of
    ``parts``; shorter vectors end in zeros. The codebooks start from the rows
    of the smallest ids (null ids last, rows of one id by their vectors); with
    fewer rows than entries, there are as many entries as rows. Ties go to the
    lower entry; entries are replaced by the floor of their parts' means, and
    unused ones stay. Repeated rows count each. Equal labels sum their errors,
    nulls together; sums beyond a long are held at its largest. An empty table
    gives an empty result; other columns take no part. ``looked``, if given,
    gets the number of distances that each round computed.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable(column(vector_col))).select(column(id_col).cast("long").alias("vec_id"), column(label_col).alias("label"), column(vector_col).alias("vector"))
    found = _codebooks(spark, kept, parts, entries, rounds, [] if looked is None else looked)
    if found is None:
        return kept.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded, books = found
    digest = sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
    rows = coded.select("vec_id", "code", "error", F.struct("label").alias("of"))  # a struct of a null equals another
    by_label = rows.groupBy("of").agg(F.count("*").alias("n"), F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    by_label = materialize(by_label, "codes-labels")
    total = by_label.agg(F.sum("n")).first()[0]
    return join_counted(rows, by_label, ["of"], total).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
