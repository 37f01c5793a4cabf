"""Exact top-k inner-product search with a three-phase uniform threshold.

(TPUT: Cao and Wang, "Efficient top-K query calculation in distributed
networks", 2004.) The components are cut into slices; a slice's partial scores
are one list for each query. Phase one gathers each list's best entries; the
k-th best sum of what is known, partial scores counted from each list's lowest,
is a lower bound of the k-th best score. Phase two sends that bound to all
blocks: an entry can only be among the best if one of its partial scores
reaches the bound divided by the number of lists. A list whose norms show that
none of a block's entries can reach it there, for any query, is not read, and an entry goes on
only if its parts that reach it, and the threshold for the others, add up to
the bound. Phase three, in the same pass over the blocks, resolves the scores
of what remains exactly. Collecting entries inside their blocks sends the k
best of each block on, never a list of partial scores.

Queries meet all rows in blocks, joined by block numbers; a block holds a
bounded number of components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .frames import column
from .store import materialize, rows_per_batch, scratch

#: Components in a block of candidates, queries in a block, and lists.
BLOCK_COMPONENTS, BLOCK_QUERIES, LISTS = 1 << 18, 1024, 4
#: Pairs of blocks that a Python worker holds at once.
PAIRS_PER_BATCH = 4


def usable(vector: Column) -> Column:
    """Not null, and no null, NaN or infinite component."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & ~wrong


def _matrix(values: pa.Array) -> np.ndarray:
    """floor(256 x) of list values as float64 rows, which hold these integers exactly; short vectors end in zeros."""
    flat = np.floor(256 * values.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    size = np.diff(values.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        widest = max(1, int(np.diff(vectors.offsets.to_numpy()).max(initial=1)))
        step = max(1, BLOCK_COMPONENTS // widest)
        rows = []
        for at in range(0, len(ids), step):
            own = _matrix(vectors.slice(at, step))
            rows.append(((part << 32) | n, len(own), own.shape[1], ids[at : at + step].astype("<i8").tobytes(), own.tobytes()))
            n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["block", "n", "width", "ids", "flat"]
        )


def _wide(q: np.ndarray, c: np.ndarray) -> bool:
    """Inner products may be beyond what float64 holds exactly."""
    return bool(q.size and c.size and q.shape[1] * np.abs(q).max() * np.abs(c).max() >= 2.0**53)


def _dot(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer rows: float64 where that is exact, else whole numbers held at the limits of a long."""
    if _wide(q, c):
        exact = np.vectorize(int, otypes=[object])(q) @ np.vectorize(int, otypes=[object])(c).T
        return np.clip(exact, -(2**63), 2**63 - 1)
    return q @ c.T


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(query row, query ids, candidate ids, query matrix, candidate matrix, own pairs), of equal widths."""
    for row in batch.to_pylist():
        ids = np.frombuffer(row["ids"], "<i8")
        c = np.frombuffer(row["flat"]).reshape(row["n"], row["width"])
        qid = np.asarray([x["vec_id"] for x in row["queries"]], np.int64)
        q = _matrix(pa.array([x["vector"] for x in row["queries"]], pa.list_(pa.float64())))
        width = max(q.shape[1], c.shape[1])
        q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
        yield row, qid, ids, q, c, qid[:, None] == ids[None, :]


def _slices(width: int, lists: int) -> list[slice]:
    step = -(-width // lists) or 1
    return [slice(k * step, (k + 1) * step) for k in range(lists)]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The k best columns of each row, smaller ids first among equals; -inf never."""
    # The k-th best of every sixteenth entry bounds the k-th best of all, and few others reach it.
    some = score[:, ::16]
    n = some.shape[1]
    cuts = np.partition(some, n - k, axis=1)[:, n - k] if n > k and len(score) and score.dtype != object else [None] * len(score)
    for own, cut in zip(score, cuts):
        at = np.flatnonzero(own > -np.inf if cut is None or cut == -np.inf else own >= cut)
        if len(at) > k:
            at = np.asarray(sorted(at.tolist(), key=lambda j: (-own[j], ids[j]))[:k]) if own.dtype == object else at[np.lexsort((ids[at], -own[at]))[:k]]
        yield at, own[at]


def _gather(k: int, lists: int):
    """Phase one: the best entries of each list, with the list's lowest partial score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], [], [], [], []]
            for row, qid, ids, q, c, own in _pairs(batch):
                for n, part in enumerate(_slices(q.shape[1], lists)):
                    score = _dot(q[:, part], c[:, part]).astype(np.float64, copy=False)
                    low = score.min(1) if len(ids) else []
                    score[own] = -np.inf
                    for i, (at, best) in enumerate(_best(score, ids, k)):
                        found[0] += [int(qid[i])] * len(at)
                        found[1] += [n] * len(at)
                        found[2] += ids[at].tolist()
                        found[3] += best.tolist()
                        found[4] += [float(low[i])] * len(at)
                        found[5] += [row["block"]] * len(at)
                        found[6] += at.tolist()
            types = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, types)], ["query_id", "list", "vec_id", "part", "low", "block", "place"])

    return run


def remaining(q: np.ndarray, c: np.ndarray, cut: np.ndarray, lows: np.ndarray, lists: int) -> tuple[np.ndarray, int]:
    """Phase two: (which entries may reach the cut, partial scores looked at); ``cut`` is NaN where fewer than k scores are known."""
    # A hair below: sums beyond 2^53 are rounded.
    share = cut * (1 - 1e-9) / lists - 1e-9 * np.abs(lows).max(1, initial=0.0)
    seen, most, read = np.zeros((len(q), len(c)), bool), np.zeros((len(q), len(c))), 0
    for n, part in enumerate(_slices(q.shape[1], lists)):
        own, other = q[:, part], c[:, part]
        reach = np.sqrt((own**2).sum(1)) * np.sqrt((other**2).sum(1).max(initial=0.0)) * (1 + 1e-9)
        unread = reach - lows[:, n] < share
        if unread.all():
            most += share[:, None]
            continue
        score = _dot(own, other).astype(np.float64, copy=False)
        score -= lows[:, n : n + 1]
        read += score.size
        seen |= score >= share[:, None]
        most += np.maximum(score, share[:, None], out=score)
    with np.errstate(invalid="ignore"):
        seen &= most >= (lists * share)[:, None]
    return seen | np.isnan(cut)[:, None], read


def _resolve(k: int, lists: int):
    """Phases two and three: the scores of the entries that remain; the k best of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], []]
            for row, qid, ids, q, c, own in _pairs(batch):
                cut = np.asarray([np.nan if x["cut"] is None else x["cut"] for x in row["queries"]], np.float64)
                lows = np.asarray([[0.0] * lists if x["lows"] is None else [dict(x["lows"]).get(n, 0.0) for n in range(lists)] for x in row["queries"]]).reshape(-1, lists)
                if _wide(q, c):
                    held = np.where(own, -np.inf, _dot(q, c))
                else:
                    enough, held = remaining(q, c, cut, lows, lists)[0] & ~own, np.full(own.shape, -np.inf)
                    for i, passed in enumerate(enough):
                        at = np.flatnonzero(passed)
                        held[i, at] = c[at] @ q[i]
                for i, (at, best) in enumerate(_best(held, ids, k)):
                    found[0] += [int(qid[i])] * len(at)
                    found[1] += ids[at].tolist()
                    found[2] += [int(x) for x in best]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    return run


def meeting(blocks: DataFrame, rows: DataFrame, entry: Column, groups: int, fan: int) -> DataFrame:
    """Each block beside each of ``groups`` lists of queries, ``entry`` of ``rows``.

    A list is copied for ``fan`` groups of candidate blocks, so that one key is
    never all of the work. The copies are made behind the sizes that the planner
    knows, so it would broadcast all of them from the driver: they are merged.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    spread = blocks.select("*", every(groups).alias("group"), F.pmod(F.xxhash64("block"), F.lit(fan)).alias("fan"))
    grouped = rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("group")).agg(F.collect_list(entry).alias("queries")).select("*", every(fan).alias("fan"))
    return spread.join(grouped.hint("merge"), ["group", "fan"]).select("block", "n", "width", "ids", "flat", "queries")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest integer inner products of each query.

    Components become floor(256 x). Ties go to the smaller id; a query's own id
    is no candidate of it; with fewer than k candidates, all are returned.
    Vectors that are null or hold null or non-finite components, and null ids,
    take no part. Shorter vectors count as ending in zeros. Repeated candidate
    rows are candidates each; of a query id with several vectors, the smallest
    vector is the query. Scores beyond a long are held at its limits. Empty
    tables give an empty result; other columns take no part.
    """
    spark = candidates.sparkSession
    name, vector = column(id_col).cast("long").alias("vec_id"), column(vector_col)
    with scratch(spark):
        return _top_k(spark, queries.where(usable(vector)), candidates.where(usable(vector)), name, vector, k, lists)


def _top_k(spark: SparkSession, queries: DataFrame, candidates: DataFrame, name: Column, vector: Column, k: int, lists: int) -> DataFrame:
    blocks = materialize(candidates.select(name, vector.alias("v")).where("vec_id is not null").mapInArrow(_blocks, "block long, n long, width long, ids binary, flat binary"), "top-blocks")
    asked = queries.select(name, vector.alias("vector")).where("vec_id is not null").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = materialize(asked, "top-queries")
    groups = max(1, -(-asked.count() // BLOCK_QUERIES))
    fan = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def met(entry: Column, rows: DataFrame) -> DataFrame:
        return meeting(blocks, rows, entry, groups, fan)

    with rows_per_batch(spark, PAIRS_PER_BATCH):
        gathered = met(F.struct("vec_id", "vector"), asked).mapInArrow(_gather(k, lists), "query_id long, list int, vec_id long, part double, low double, block long, place long")
        gathered = materialize(gathered, "top-gathered")
        order = Window.partitionBy("query_id", "list").orderBy(F.col("part").desc(), "vec_id")
        lists_best = gathered.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
        lows = gathered.groupBy("query_id", "list").agg(F.min("low").alias("low"))
        known = lists_best.join(lows.withColumnRenamed("low", "least_low"), ["query_id", "list"]).drop("low").withColumnRenamed("least_low", "low")
        known = known.groupBy("query_id", "block", "place")  # a row each: an id may have several vectors
        known = known.agg(F.sum(F.col("part") - F.col("low")).alias("least"))
        best = Window.partitionBy("query_id").orderBy(F.col("least").desc())
        cuts = known.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select("query_id", F.col("least").alias("cut"))
        maps = lows.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("list", "low"))).alias("lows"))
        bounds = cuts.join(maps, "query_id").withColumnRenamed("query_id", "vec_id")
        told = asked.join(bounds, "vec_id", "left")
        resolved = met(F.struct("vec_id", "vector", "cut", "lows"), told).mapInArrow(_resolve(k, lists), "query_id long, vec_id long, score long")
        resolved = materialize(resolved, "top-resolved", keep=True)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return resolved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
