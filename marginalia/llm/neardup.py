"""Near-duplicate documents: banded MinHash candidates, odd sketches, full sets.

One pass over the texts makes, for each document, its set size, a 128-bit hash
of its set, band keys of its MinHash samples, and an odd sketch: the samples
folded into a parity bitmap (Mitzenmacher, Pagh and Pham, 2014). The population
count of two sketches' XOR tells high similarities apart precisely.

Documents of one text (its words, A-Z lower-cased) are one node, named by its
smallest id; a cryptographic digest of the whole text tells them apart. Nodes
that share a band key and whose sketches are close form families; inside a
family, full sets are compared. With BANDS x ROWS samples, a pair at the
threshold of 0.85 shares no band with probability 7e-10; the sketch bound lies
6.5 standard deviations away.

Buckets and families of any size are compared alike (:func:`forest`): a small
one in a task, all pairs; of a large one, a few pivots are compared with all
members first, in chunks. What the pivots connect needs no further look among
itself; only the members outside are then compared with all others, in pairs of
blocks. A group of a million near copies so costs a few comparisons each, and
no link is lost. All steps give back only spanning forests of the pairs they
found, so their output grows with the nodes, never with the pairs. Nothing is
dealt out by a key that could be hot: members of large groups are dealt by
chunks, and what is known of a large group is brought to its members where
they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .frames import column, join_counted, pack, unpack
from .graph import components
from .store import materialize, rows_per_batch, scratch
from .tokens import chunks, column_bytes
from .workers import TEXTS_PER_BATCH, map_arrow

BANDS, ROWS = 36, 5
SKETCH_BITS = 512
#: Most nodes in a block of a bucket; most shingles and nodes in a block of a family. Two blocks meet in a task.
BUCKET_BLOCK, FAMILY_BLOCK, FAMILY_NODES = 2048, 300_000, 1024
#: Members of a large group that all others are compared with first.
PIVOTS = 8
#: Pairs of blocks that a Python worker holds at once.
GROUPS_PER_BATCH = 64

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64; x is changed."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


_PLACE = _odd(8, 7)


def shingle_sets(texts: list[bytes | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all documents' distinct shingles in document order, set size of each document)."""
    split = [text.lower().split() if text else [] for text in texts]  # bytes.lower: A-Z only
    counts = np.asarray([len(w) for w in split], np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, (w for own in split for w in own)), np.uint64, int(counts.sum()))
    doc = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    # A document with fewer words is one shingle: its first ``counts`` words.
    width = np.minimum(counts, words)[doc]
    start = np.arange(len(hashes)) - first[doc]
    begins = np.flatnonzero(start + width <= counts[doc])
    own, wide = doc[begins], width[begins]
    value = _mix(wide.astype(np.uint64) * _PLACE[0])
    for k in range(words):
        at = np.minimum(begins + k, max(0, len(hashes) - 1))
        value = np.where(wide > k, _mix((value ^ hashes[at]) * _PLACE[1 + k % 7] + _U(k + 1)), value) if len(begins) else value
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[new], own[new]
    return value, np.bincount(own, minlength=len(texts))


def _signatures(words: int, bands: int, rows: int, bits: int):
    samples = bands * rows
    factor, shift = _odd(samples, 1), _odd(samples, 2)
    fold, salt = _odd(rows, 3), _odd(bands, 4)
    place = _odd(samples, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = column_bytes(batch, "text"), batch.column(0)
            for begin, end in chunks(texts):
                value, sizes = shingle_sets(texts[begin:end], words)
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                least = np.empty((samples, len(full)), np.uint64)
                for k in range(samples if len(full) else 0):
                    np.minimum.reduceat(value * factor[k] + shift[k], starts, out=least[k])
                keys = np.zeros((bands, len(full)), np.uint64)
                for r in range(rows):
                    keys = _mix((keys ^ least[r::rows]) * fold[r])
                keys = _mix(keys + salt[:, None]).T
                cell = (_mix(least * place[:, None]) >> _U(64 - int(bits).bit_length() + 1)).astype(np.int64).T
                cell += np.arange(len(full))[:, None] * bits
                parity = np.bincount(cell.ravel(), minlength=bits * len(full)).reshape(len(full), bits) & 1
                sketch = np.packbits(parity.astype(np.uint8), axis=1)
                digest = [blake2b(b" ".join(texts[begin + i].lower().split()), digest_size=16).digest() for i in full.tolist()]
                n = end - begin
                some = np.zeros(n, bool)
                some[full] = True
                gap = pa.array(~some)
                slot = np.cumsum(some) - 1
                halves = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                take = pa.array(np.where(some, slot, 0), mask=~some)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(begin, n), pa.array(sizes), pa.array(halves[:, 0]).take(take), pa.array(halves[:, 1]).take(take),
                        pa.ListArray.from_arrays(np.arange(0, bands * len(full) + 1, bands, dtype=np.int32), pa.array(keys.view(np.int64).ravel())).take(take),
                        pa.array([s.tobytes() for s in sketch], pa.binary()).take(take),
                    ],
                    ["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"],
                )

    return run


def sketch_distance(similarity: float, samples: int, bits: int, sigmas: float = 6.5) -> int:
    """XOR population count that a pair of that similarity exceeds only ``sigmas`` standard deviations out."""
    differ = samples * (1 - similarity)
    load = np.exp(-4 * differ / bits)
    slope = 2 * load
    collisions = (2 * differ) ** 2 / (2 * bits)
    spread = np.sqrt(slope**2 * differ * similarity + 4 * collisions)
    return int(min(bits, bits / 2 * (1 - load) + sigmas * spread + 1))


def spanning_forest(near: Callable[[int], np.ndarray], n: int) -> list[tuple[int, int]]:
    """Pairs i < j that connect what ``near(i)``, a mask of i+1..n-1, connects; fewer than n of them."""
    found, label = [], np.arange(n)
    for i in range(n - 1):
        at = np.flatnonzero(near(i) & (label[i + 1 :] != label[i])) + i + 1
        if len(at):
            others, first = np.unique(label[at], return_index=True)
            found += [(i, j) for j in at[first].tolist()]
            label[np.isin(label, others)] = label[i]
    return found


def common_counts(value: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Sizes of all pairs' intersections of n sets given as (value, set), as an n x n matrix."""
    order = np.argsort(value, kind="stable")
    value, own = value[order], own[order]
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, int)
    size = np.diff(np.append(starts, len(value)))
    out = np.zeros((n, n), np.float32)
    # Few sets hold the shingle: count its pairs. Many do: multiply indicator rows.
    for k in range(2, 9):
        at = starts[size == k]
        if len(at):
            held = own[at[:, None] + np.arange(k)]
            a, b = np.triu_indices(k, 1)
            pair = np.minimum(held[:, a], held[:, b]) * n + np.maximum(held[:, a], held[:, b])
            out += np.bincount(pair.ravel(), minlength=n * n).reshape(n, n)
    many = np.flatnonzero(size > 8)
    for begin in range(0, len(many), 4096):
        part = many[begin : begin + 4096]
        row = np.zeros((n, len(part)), np.float32)
        for c, k in enumerate(part):
            row[own[starts[k] : starts[k] + size[k]], c] = 1
        out += np.triu(row @ row.T, 1)
    return out.astype(np.int64)


def cross_counts(value: np.ndarray, own: np.ndarray, n: int, other: np.ndarray, others: np.ndarray, m: int) -> np.ndarray:
    """Sizes of the intersections of n sets with m others, as an n x m matrix."""
    if n > 16:
        both = common_counts(np.concatenate([value, other]), np.concatenate([own, others + n]), n + m)
        return both[:n, n:]
    stops = np.cumsum(np.bincount(own, minlength=n))
    out = np.zeros((n, m), np.int64)
    for i, stop in enumerate(stops):
        mine = value[stops[i - 1] if i else 0 : stop]  # sorted within a set
        at = np.minimum(np.searchsorted(mine, other), max(0, len(mine) - 1))
        if len(mine):
            out[i] = np.bincount(others[mine[at] == other], minlength=m)
    return out


class SketchKernel:
    """Which sketches differ in at most ``most`` bits."""

    def __init__(self, most: int):
        self.most = most

    def read(self, values: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(values), np.uint64).reshape(len(values), -1)

    def among(self, rows: np.ndarray) -> Callable[[int], np.ndarray]:
        return lambda i: np.bitwise_count(rows[i + 1 :] ^ rows[i]).sum(1, dtype=np.int64) <= self.most

    def between(self, left: np.ndarray, right: np.ndarray) -> Iterator[np.ndarray]:
        for own in left:
            yield np.bitwise_count(right ^ own).sum(1, dtype=np.int64) <= self.most


class SetKernel:
    """Which texts' full sets are similar enough."""

    def __init__(self, words: int, percent: int):
        self.words, self.percent = words, percent

    def read(self, values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return shingle_sets([v.encode() if v else None for v in values], self.words)

    def _alike(self, common: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
        return (100 * common >= self.percent * (sizes[:, None] + others[None, :] - common)) & (common > 0)

    def among(self, rows: tuple[np.ndarray, np.ndarray]) -> Callable[[int], np.ndarray]:
        value, sizes = rows
        alike = self._alike(common_counts(value, np.repeat(np.arange(len(sizes)), sizes), len(sizes)), sizes, sizes)
        return lambda i: alike[i, i + 1 :]

    def between(self, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> Iterator[np.ndarray]:
        (a, na), (b, nb) = left, right
        common = cross_counts(a, np.repeat(np.arange(len(na)), na), len(na), b, np.repeat(np.arange(len(nb)), nb), len(nb))
        yield from self._alike(common, na, nb)


def _edges(us: list, vs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _all_pairs(kernel):
    """Spanning forest of each small group's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for members in batch.column(0).to_pylist():
                members.sort(key=lambda m: m["node"])
                node = [m["node"] for m in members]
                for i, j in spanning_forest(kernel.among(kernel.read([m["value"] for m in members])), len(node)):
                    us.append(node[i])
                    vs.append(node[j])
            yield _edges(us, vs)

    return run


def _pivot_links(kernel):
    """(group, node, mask of the pivots that it is alike to, u, v) of the members of a chunk; u and v connect it and the pivots."""
    names = ["group", "node", "mask", "u", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            for group, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pivots = [m for m in members if m["apart"]]
                others = [m for m in members if not m["apart"]]
                if not pivots or not others:
                    continue
                names_of = sorted({m["node"] for m in pivots})
                bit = {n: k for k, n in enumerate(names_of)}
                mask = np.zeros(len(others), np.int64)
                for p, alike in zip(pivots, kernel.between(kernel.read([m["value"] for m in pivots]), kernel.read([m["value"] for m in others]))):
                    mask |= alike.astype(np.int64) << bit[p["node"]]
                up = list(range(len(names_of)))
                for m, bits in zip(others, mask.tolist()):
                    held = [k for k in range(len(names_of)) if bits >> k & 1]
                    rows = [(group, m["node"], bits, m["node"] if held else None, names_of[held[0]] if held else None)]
                    for k in held[1:]:
                        if up[k] != up[held[0]]:
                            rows.append((group, None, None, m["node"], names_of[k]))
                            up = [up[held[0]] if x == up[k] else x for x in up]
                    for column_, values in zip(found, zip(*rows)):
                        column_ += values
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names)

    return run


def _block_links(kernel):
    """Spanning forest of the pairs between a block's members apart and its others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for members in batch.column(0).to_pylist():
                left, right = ([m for m in members if m["apart"] == own] for own in (True, False))
                if not left or not right:
                    continue
                label = np.unique([m["node"] for m in [*left, *right]], return_inverse=True)[1]
                for i, alike in enumerate(kernel.between(kernel.read([m["value"] for m in left]), kernel.read([m["value"] for m in right]))):
                    own = label[len(left) :]
                    at = np.flatnonzero(alike & (own != label[i]))
                    if len(at):
                        merged, first = np.unique(own[at], return_index=True)
                        us += [left[i]["node"]] * len(merged)
                        vs += [right[j]["node"] for j in at[first].tolist()]
                        label[np.isin(label, merged)] = label[i]
            yield _edges(us, vs)

    return run


def forest(members: DataFrame, payload: DataFrame, kernel, tag: str) -> DataFrame:
    """(u, v): edges that connect, in each group, the members that a chain of alike members connects.

    ``members`` is a written table (group, node, blocks): into how many blocks a
    group's members are to be dealt, so that two blocks fit a task; ``payload``
    is (node, value), what the kernel compares.
    """
    spark = members.sparkSession
    entry = F.collect_list(F.struct("apart", "node", "value")).alias("members")
    small = members.where("blocks = 1").join(payload, "node").groupBy("group").agg(F.collect_list(F.struct("node", "value")).alias("members"))
    with rows_per_batch(spark, GROUPS_PER_BATCH):
        out = materialize(map_arrow(small.select("members"), _all_pairs(kernel), "u long, v long"), f"{tag}-small")
    large = members.where("blocks > 1")
    if large.isEmpty():
        return out
    own = large.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("blocks")))
    total = large.count()
    chosen = large.groupBy("group", "blocks").agg(F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(PIVOTS)])).alias("pivots"))
    pivots = chosen.select("group", "blocks", F.explode("pivots").alias("node")).join(payload, "node")
    pivots = pivots.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("chunk"), F.lit(True).alias("apart"), "node", "value")
    met = pivots.union(own.join(payload, "node").select("group", "chunk", F.lit(False), "node", "value")).groupBy("group", "chunk").agg(entry)
    with rows_per_batch(spark, GROUPS_PER_BATCH):
        linked = materialize(map_arrow(met.select("group", "members"), _pivot_links(kernel), "group long, node long, mask long, u long, v long"), f"{tag}-pivots")
    out = out.union(linked.where("u is not null").select("u", "v"))

    # Pivots that members connect are one; the members of the most frequent one's component need no further look among themselves.
    masks = linked.where("node is not null").groupBy("group", "mask").agg(F.count("*").alias("m"))
    masks = masks.groupBy("group").agg(F.sum("m").alias("n"), F.collect_list("mask").alias("masks"), F.max_by("mask", F.when(F.col("mask") != 0, F.col("m"))).alias("most"))
    grown = F.aggregate("masks", F.coalesce("most", F.lit(0).cast("long")), lambda a, x: F.when(a.bitwiseAND(x) != 0, a.bitwiseOR(x)).otherwise(a))
    for _ in range(PIVOTS - 1):
        grown = F.aggregate("masks", grown, lambda a, x: F.when(a.bitwiseAND(x) != 0, a.bitwiseOR(x)).otherwise(a))
    mains = materialize(masks.select("group", "n", grown.alias("main")), f"{tag}-mains")
    apart = join_counted(linked.where("node is not null").select("group", "node", "mask"), mains, ["group"], linked.count()).where(F.col("mask").bitwiseAND(F.col("main")) == 0)
    apart = materialize(apart.select("group", "node").distinct(), f"{tag}-apart")
    if apart.isEmpty():
        return out
    sizes = apart.groupBy("group").agg(F.count("*").alias("r"))
    sizes = materialize(sizes.join(large.groupBy("group", "blocks").agg(F.count("*").alias("n")), "group").select("group", "n", F.ceil(F.col("r") * F.col("blocks") / F.col("n")).alias("rows")), f"{tag}-rows")
    placed = join_counted(own, sizes, ["group"], total)
    rest = placed.join(apart, ["group", "node"], "left_semi")
    i, j = F.pmod(F.xxhash64("node", F.lit(1)), F.col("rows")), F.col("chunk")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rest.join(payload, "node").select("group", i.alias("i"), upto("blocks").alias("j"), F.lit(True).alias("apart"), "node", "value")
    right = placed.join(payload, "node").select("group", upto("rows").alias("i"), j.alias("j"), F.lit(False).alias("apart"), "node", "value")
    met = left.union(right).groupBy("group", "i", "j").agg(entry)
    with rows_per_batch(spark, GROUPS_PER_BATCH):
        return out.union(materialize(map_arrow(met.select("members"), _block_links(kernel), "u long, v long"), f"{tag}-blocks"))


def _links(nodes: DataFrame, texts: DataFrame, words: int, percent: int, samples: int, bits: int) -> DataFrame:
    """(u, v): edges that connect the nodes whose full sets are similar enough; ``nodes`` is written."""
    # Buckets with two nodes or more; those with the same members are looked at once.
    banded = nodes.select("node", F.explode("bands").alias("key"))
    repeated = banded.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n")).where("a < b").select("key", "n")
    members = materialize(join_counted(banded, materialize(repeated, "near-keys"), ["key"], BANDS * nodes.count(), "left_semi"), "near-members")
    h = F.xxhash64("node")
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.shiftright(h, 32)).alias("s"), F.bit_xor(h).alias("x"))
    buckets = buckets.groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key", "n", F.ceil(F.col("n") / F.lit(BUCKET_BLOCK)).alias("blocks"))
    members = join_counted(members, materialize(buckets, "near-buckets"), ["key"], members.count())
    members = materialize(members.select(F.col("key").alias("group"), "node", "blocks"), "near-grouped")
    close = forest(members, nodes.select("node", F.col("sketch").alias("value")), SketchKernel(sketch_distance(percent / 100, samples, bits)), "near-close")

    # Families of close nodes; full sets are compared inside them.
    family = materialize(components(close), "near-families").join(nodes.groupBy("node").agg(F.max("n_shingles").alias("size")), "node")
    family = materialize(family, "near-sized")
    blocks = F.ceil(F.greatest(F.sum("size") / F.lit(FAMILY_BLOCK), F.count("*") / F.lit(FAMILY_NODES))).alias("blocks")
    sizes = materialize(family.groupBy("root").agg(blocks, F.count("*").alias("n")), "near-blocks")
    members = materialize(join_counted(family, sizes, ["root"], family.count()).select(F.col("root").alias("group"), "node", "blocks"), "near-placed")
    # Texts of the families alone, written once: each is read for a pass over pivots, and again only if that leaves some apart.
    payload = materialize(texts.join(members.select("node"), "node", "left_semi"), "near-texts")
    return forest(members, payload, SetKernel(words, percent), "near-linked")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    A document's set holds its distinct shingles of ``words`` words (A-Z lower-
    cased); with fewer words, the whole sequence is the one shingle. Documents
    are linked if 100 times the intersection is at least ``percent`` times the
    union. component_id is the smallest id reachable. Documents without words
    have size 0 and no link. Rows of one id are one document: what one of them
    links to, all do. Rows with a null id are linked to nothing and kept. An
    empty table gives an empty result; other columns take no part. Shingles of
    a pair are told apart by 64 bits.
    """
    spark = docs.sparkSession
    skinny = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    with scratch(spark):
        signed = map_arrow(skinny, _signatures(words, bands, rows, bits), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch binary")
        with rows_per_batch(spark, TEXTS_PER_BATCH):
            signed = materialize(signed, "near-signatures", keep=True)
        total = signed.count()
        some = signed.where("n_shingles > 0 and doc_id is not null")
        # One text: one node, named by its smallest id.
        same = materialize(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "near-same")
        named = join_counted(some, same, ["h1", "h2"], total)
        nodes = materialize(named.where("doc_id = node").select("node", "n_shingles", "bands", "sketch").dropDuplicates(["node", "sketch"]), "near-nodes")
        links = _links(nodes, skinny.withColumnRenamed("doc_id", "node").withColumnRenamed("text", "value"), words, percent, bands * rows, bits)
        # Ids with several texts connect their nodes.
        slim = join_counted(some.select("doc_id", "h1", "h2"), same, ["h1", "h2"], total).select("doc_id", "node").distinct()
        several = slim.groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).where("least < most")
        bridges = slim.join(several, "doc_id").where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
        found = materialize(components(links.union(bridges)), "near-found")
        roots = same.join(found, "node", "left").select("h1", "h2", "n", F.coalesce("root", "node").alias("root"))
        roots = materialize(roots, "near-roots", keep=True)
    unlinked = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("root"))
    linked = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "h1", "h2")
    out = join_counted(linked, roots, ["h1", "h2"], total).select("doc_id", "n_shingles", "root").union(unlinked)
    return out.select("doc_id", "n_shingles", F.col("root").alias("component_id"), F.col("root").eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents of a component other than its smallest id; all columns stay, whatever their names."""
    gone = near_duplicates(docs, id_col=id_col, **options).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    gone = materialize(gone, "near-gone")
    rows = pack(docs).withColumn("own_id", F.col("row")[id_col].cast("long"))
    kept = rows.where("own_id is not null").join(gone, F.col("own_id") == F.col("gone_id"), "left_anti")
    return unpack(kept.unionByName(rows.where("own_id is null")), docs.columns, {})  # rows with a null id meet no join
