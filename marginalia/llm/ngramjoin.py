"""Similarity join of documents on their word n-grams, by rare-first prefixes.

(Xiao, Wang, Lin, Yu and Wang, "Efficient similarity joins for near-duplicate
detection", 2011.) Each set of n-grams is put in one global order, rare ones
first. Two sets that overlap enough share an n-gram of their prefixes, and at
the first one that they share, what is left of both bounds their overlap.

1. Equal sets are one node. Of each set, the first n-grams in the order of
   their hashes are counted, more than a prefix needs: a set with a partner
   holds several of them that another set holds, too. All others are done.
2. The n-grams of the remaining sets are counted and put in order, those of one
   set first of all, and the prefixes are cut.
3. Prefixes meet by n-gram. An entry (size, position) reaches sizes up to some
   bound, which is the length filter and the positional filter in one, and two
   entries are candidates if each reaches the other's size. Of the entries of
   one n-gram and size, the first in position reaches all that any reaches; so
   an entry needs one edge only, to that one, or to the one that reaches
   farthest among smaller sizes: whoever it meets there are candidates of each
   other. Edges grow with the entries, never with their pairs, and entries of
   a frequent n-gram are summed up before they meet.
4. Candidates that hang together are families. Inside a family, a pair passes
   the suffix filter (counts in cells of the hash range bound the overlap), and
   then its full sets are compared, once. Large families are compared through
   pivots first (:func:`~marginalia.llm.neardup.forest`).

N-grams held by very many documents are found in a part of the rows and brought
to where they occur; no task gets all of such an n-gram's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .frames import HOT_ROWS, HOT_SHARE, column, join_counted
from .graph import components
from .neardup import FAMILY_BLOCK, FAMILY_NODES, SetKernel, common_counts, forest, shingle_sets
from .store import materialize, rows_per_batch, scratch
from .tokens import chunks, column_bytes
from .workers import TEXTS_PER_BATCH, map_arrow

#: One in so many rows shows which n-grams are frequent.
ONE_IN = 64
#: Cells of the suffix filter.
CELLS = 64


def least_common(size, percent: int):
    """Fewest n-grams that a set of that size has in common with any partner."""
    return -(-size * percent // 100)


def _extra(size):
    """How many n-grams that first prefixes share are asked for."""
    return size // 10 + 1


def _digests(value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128-bit digests of sorted sets, as rows of two longs; empty sets' are not to be used."""
    stops = np.cumsum(sizes)
    raw = value.astype("<u8").tobytes()
    return np.frombuffer(b"".join(blake2b(raw[8 * (stop - n) : 8 * stop], digest_size=16).digest() for stop, n in zip(stops.tolist(), sizes.tolist())), "<i8").reshape(-1, 2)


def _signed(words: int, percent: int):
    """Sets' sizes and digests, and their first n-grams in the order of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, ids = column_bytes(batch, "text"), batch.column(0)
            for begin, end in chunks(texts):
                value, sizes = shingle_sets(texts[begin:end], words)
                halves = _digests(value, sizes)
                long = np.minimum(sizes, sizes - least_common(sizes, percent) + _extra(sizes)) * (sizes > 0)
                first = np.cumsum(sizes) - sizes
                at = np.repeat(first - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
                offsets = pa.array(np.concatenate([[0], np.cumsum(long)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(begin, end - begin), pa.array(sizes), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array((np.int64(part) << 33) + row + np.arange(end - begin)),
                        pa.ListArray.from_arrays(offsets, pa.array(value[at].view(np.int64))),
                    ],
                    ["doc_id", "n_shingles", "h1", "h2", "own", "low"],
                )
                row += end - begin

    return run


def _matching(words: int):
    """Texts whose set is the node's: an id may have other texts beside it. Repeated rows follow each other and go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            texts, nodes = column_bytes(batch, "value"), batch.column(0).to_pylist()
            asked = np.stack([batch.column(k).to_numpy() for k in (1, 2)], 1)
            keep = []
            for begin, end in chunks(texts):
                same = (_digests(*shingle_sets(texts[begin:end], words)) == asked[begin:end]).all(1)
                for i in (np.flatnonzero(same) + begin).tolist():
                    if nodes[i] != last:
                        keep.append(i)
                        last = nodes[i]
            yield batch.select(["node", "n_shingles", "value"]).take(pa.array(keep, pa.int64()))

    return run


def _exploded(words: int):
    """(token, node, size) of all n-grams of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, nodes = column_bytes(batch, "value"), batch.column(0).to_numpy()
            for begin, end in chunks(texts):
                value, sizes = shingle_sets(texts[begin:end], words)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.repeat(nodes[begin:end], sizes)), pa.array(np.repeat(sizes, sizes))], ["token", "node", "size"])

    return run


def repeated_tokens(rows: DataFrame, some: DataFrame, total: int) -> DataFrame:
    """``rows`` (token, node, ...) whose token several nodes hold, with ``n``, one number for each token that orders tokens by frequency.

    ``some`` is one in ONE_IN of the rows. Tokens that are frequent in it, at
    most 1 / HOT_SHARE or so, are told to the rows where they are; each of their
    rows is a group of its own in the window that counts the others, so no
    task gets all rows of a frequent token.
    """
    most = max(HOT_ROWS, int(total * HOT_SHARE)) / ONE_IN
    hot = materialize(some.groupBy("token").agg((F.count("*") * ONE_IN).alias("told")).where(F.col("told") > most * ONE_IN), "join-hot")
    apart = F.when(F.col("told").isNotNull(), F.xxhash64("node")).otherwise(0)
    alike = Window.partitionBy("token", "apart")
    counted = rows.join(F.broadcast(hot), "token", "left").withColumn("apart", apart).withColumns({"n": F.count("*").over(alike), "a": F.min("node").over(alike), "b": F.max("node").over(alike)})
    return counted.where("told is not null or a < b").withColumn("n", F.coalesce("told", "n")).drop("a", "b", "told", "apart")


class JoinKernel(SetKernel):
    """Full sets, behind a suffix filter."""

    def read(self, values: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value, sizes = super().read(values)
        cell = np.repeat(np.arange(len(sizes)), sizes) * CELLS + (value >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)
        return value, sizes, np.bincount(cell, minlength=len(sizes) * CELLS).reshape(len(sizes), CELLS).astype(np.int32)

    def may(self, cells: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The suffix filter: which of the others may overlap enough; no cell holds more in common than the smaller count."""
        return (100 + self.percent) * np.minimum(others, cells).sum(1, dtype=np.int64) >= self.percent * (size + sizes)

    def among(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Callable[[int], np.ndarray]:
        value, sizes, cells = rows
        n = len(sizes)
        may = np.zeros((n, n), bool)
        for i in range(n - 1):
            may[i, i + 1 :] = self.may(cells[i], sizes[i], cells[i + 1 :], sizes[i + 1 :])
        left = may.any(0) | may.any(1)
        slot, own = np.cumsum(left) - 1, np.repeat(np.arange(n), sizes)
        kept = left[own]
        common = common_counts(value[kept], slot[own[kept]], int(left.sum()))
        may[np.ix_(left, left)] &= self._alike(common, sizes[left], sizes[left])
        return lambda i: may[i, i + 1 :]

    def between(self, left: tuple, right: tuple) -> Iterator[np.ndarray]:
        (a, na, ca), (b, nb, cb) = left, right
        stops, own = np.cumsum(na), np.repeat(np.arange(len(nb)), nb)
        for i, stop in enumerate(stops.tolist()):
            mine, may = a[stop - na[i] : stop], self.may(ca[i], na[i], cb, nb)  # sorted within a set
            there = may[own]
            other = b[there]
            at = np.minimum(np.searchsorted(mine, other), max(0, len(mine) - 1))
            common = np.bincount(own[there][mine[at] == other], minlength=len(nb)) if len(mine) else np.zeros(len(nb), np.int64)
            yield may & self._alike(common[None], na[i : i + 1], nb)[0]


def prefixes(tokens: DataFrame, percent: int) -> DataFrame:
    """(token, node, size, reach) of the entries of prefixes; ``tokens`` is (token, node, size, n) of repeated tokens.

    Tokens of one set alone stand before all others and meet nothing. An entry
    reaches sizes up to ``reach``.
    """
    common = F.ceil(F.col("size") * percent / 100).cast("long")
    held = tokens.groupBy("node", "size").agg(F.collect_set(F.struct("n", "token")).alias("held"))
    alone = F.col("size") - F.size("held")
    held = held.withColumn("alone", alone).withColumn("upto", F.col("size") - common + 1 - F.col("alone")).where("upto > 0")
    entries = held.select("node", "size", "alone", F.posexplode(F.slice(F.array_sort("held"), F.lit(1), F.col("upto").cast("int"))).alias("place", "x"))
    rest = F.col("size") - F.col("alone") - F.col("place")
    return entries.select(F.col("x.token").alias("token"), "node", "size", (F.floor(rest * (100 + percent) / percent) - F.col("size")).alias("reach"))


def candidate_edges(entries: DataFrame, total: int) -> DataFrame:
    """(u, v): edges that connect all nodes that are candidates of each other; ``entries`` is written, ``total`` its rows."""
    first = entries.groupBy("token", "size").agg(F.max(F.struct("reach", "node")).alias("first"), F.count("*").alias("n"))
    smaller = Window.partitionBy("token").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(first.withColumn("below", F.max("first").over(smaller)).where("n > 1 or below.reach >= size"), "join-first")
    met = join_counted(entries, first, ["token", "size"], total)
    own = (F.col("node") != F.col("first.node")) & (F.col("reach") >= F.col("size"))
    to = F.when(own, F.col("first.node")).when(F.col("below.reach") >= F.col("size"), F.col("below.node"))
    return met.select(F.col("node").alias("u"), to.alias("v")).where("v is not null").distinct()


def _links(signed: DataFrame, same: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    low = lambda rows: rows.where("n_shingles > 0 and doc_id is not null").select(F.explode("low").alias("token"), F.col("h1").alias("node"))
    total = signed.agg(F.coalesce(F.sum(F.size("low")), F.lit(0))).first()[0]
    shared = repeated_tokens(low(signed), low(signed.where(F.pmod(F.xxhash64("own"), F.lit(ONE_IN)) == 0)), total)
    # Rows of equal sets count each; a partner may be smaller, and asks for fewer.
    need = F.floor(F.ceil(F.col("size") * percent / 100) / 10) + 1
    shared = shared.groupBy(F.col("node").alias("h1")).agg(F.count("*").alias("shared"))
    left = same.join(shared, "h1").where(F.col("shared") >= need * F.col("n")).select(F.col("least_id").alias("doc_id"), "node", "h1", "h2", F.col("size").alias("n_shingles"))
    left = materialize(left, "join-left")
    # By sort and merge at every size: what is left grows with the corpus.
    found = texts.join(left.hint("merge"), "doc_id").select("node", "h1", "h2", "n_shingles", F.col("text").alias("value"))
    with rows_per_batch(texts.sparkSession, TEXTS_PER_BATCH):
        payload = materialize(map_arrow(found, _matching(words), "node long, n_shingles long, value string"), "join-texts")

        tokens = lambda rows: map_arrow(rows.select("node", "value"), _exploded(words), "token long, node long, size long")
        total = payload.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
        counted = repeated_tokens(tokens(payload), tokens(payload.where(F.pmod(F.xxhash64("node"), F.lit(ONE_IN)) == 0)), total)
        entries = materialize(prefixes(counted, percent), "join-entries")
    close = candidate_edges(entries, entries.count())

    family = materialize(components(close), "join-families").join(left.select("node", F.col("n_shingles").alias("size")), "node")
    family = materialize(family, "join-sized")
    blocks = F.ceil(F.greatest(F.sum("size") / F.lit(FAMILY_BLOCK), F.count("*") / F.lit(FAMILY_NODES))).alias("blocks")
    sizes = materialize(family.groupBy("root").agg(blocks, F.count("*").alias("n")), "join-blocks")
    members = materialize(join_counted(family, sizes, ["root"], family.count()).select(F.col("root").alias("group"), "node", "blocks"), "join-members")
    return forest(members, payload.select("node", "value"), JoinKernel(words, percent), "join")


def join_ngrams(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    A document's set holds its distinct shingles of ``words`` words (A-Z lower-
    cased); with fewer words, the whole sequence is the one shingle. Documents
    are linked if 100 times the intersection is at least ``percent`` times the
    union; component_id is the smallest id reachable. Documents without words
    have size 0 and no link. Rows of one id are one document: what one of them
    links to, all do. Rows with a null id are linked to nothing. An empty table
    gives an empty result; other columns take no part. Shingles are told apart
    by 64 bits, sets by 128.
    """
    spark = docs.sparkSession
    skinny = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    with scratch(spark):
        with rows_per_batch(spark, TEXTS_PER_BATCH):
            signed = materialize(map_arrow(skinny, _signed(words, percent), "doc_id long, n_shingles long, h1 long, h2 long, own long, low array<long>"), "join-signed", keep=True)
        total = signed.count()
        some = signed.where("n_shingles > 0 and doc_id is not null").drop("low")
        same = some.groupBy("h1", "h2").agg(F.min("own").alias("node"), F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("size"), F.count("*").alias("n"))
        same = materialize(same, "join-same")
        links = _links(signed, same, skinny, words, percent)
        # Ids with several sets connect their nodes.
        slim = join_counted(some.select("doc_id", "h1", "h2"), same, ["h1", "h2"], total).select("doc_id", "node").distinct()
        several = slim.groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).where("least < most")
        bridges = slim.join(several, "doc_id").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
        found = materialize(components(links.union(bridges)), "join-found")
        named = materialize(same.join(found, "node", "left").select("h1", "h2", "n", "least_id", F.coalesce("root", "node").alias("root")), "join-named")
        ids = materialize(named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")), "join-ids")
        roots = join_counted(named.select("h1", "h2", F.col("n").alias("copies"), "root"), ids, ["root"], named.count()).select("h1", "h2", F.col("copies").alias("n"), "component_id")
        roots = materialize(roots, "join-roots", keep=True)
    unlinked = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "h1", "h2")
    return join_counted(linked, roots, ["h1", "h2"], total).select("doc_id", "n_shingles", "component_id").union(unlinked)
