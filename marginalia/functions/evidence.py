"""Candidate evidence: string similarity, the acceptance gate and term memory."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.folders import fresh_folder

#: Least similarity of a remembered term.
SIMILAR = 0.62


def folded(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"(?U)\s+", " ")))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of folded texts; 1 if both are empty, 0 if one is."""
    x, y = folded(a), folded(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(1 - F.levenshtein(x, y) / longest.cast("double"))


def gate(raw: Column, candidates: Column, quality: Column, agreement: Column, memory: Column | None = None, language: Column | None = None, margin: float = 0.2) -> Column:
    """struct<decision, accepted, risk, visual, best, best_similarity>.

    Only the similarity differs between candidates, so the first most similar
    one is the best; blank candidates do not count, and without any the raw
    text is the candidate.
    """
    memory, language = F.lit(0.0) if memory is None else memory, F.lit(0.5) if language is None else language
    some = F.filter(candidates, lambda c: F.trim(c) != "")
    pool = F.when(F.size(some) > 0, some).otherwise(F.array(raw))
    scored = F.transform(pool, lambda c, i: F.struct(similarity(raw, c).alias("s"), (-i).alias("back"), c.alias("text")))
    top = F.array_max(scored)
    best = top["s"] * 0.60 + quality * 0.15 + agreement * 0.15 + memory * 0.10 + language * 0.10
    visual = F.least(F.lit(1.0), F.greatest(F.lit(0.0), quality * 0.45 + agreement * 0.35 + memory * 0.15 + language * 0.15 + F.greatest(F.lit(0.0), best - 0.5) * 0.7))
    risk = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - visual + margin))
    decision = F.when(visual < 0.45, "ABSTAIN").when(visual < 0.78, "REVIEW").otherwise("ACCEPT")
    accepted = F.when((visual >= 0.78) | ((visual >= 0.45) & (F.trim(raw) == "")), top["text"]).otherwise(raw)
    r4 = lambda v: F.floor(v * 10000 + 0.5) / 10000.0
    return F.struct(decision.alias("decision"), accepted.alias("accepted"), r4(risk).alias("risk"), r4(visual).alias("visual"), top["text"].alias("best"), r4(top["s"]).alias("best_similarity"))


#: What terms are freed of at both ends.
OUTER = ".,;:!?()[]{}\"'"


def _terms(texts: DataFrame, *keys: Column | str) -> DataFrame:
    """``keys`` with i, term: terms of at least two characters, in their case: words cut at white space, / and -, without outer punctuation."""
    words = texts.select(*keys, F.posexplode(F.split("text", r"(?U)[\s/-]+")).alias("i", "term"))
    return words.withColumn("term", F.btrim("term", F.lit(OUTER))).where(F.length("term") >= 2)


def remember(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document_id, id, text) -> each document's terms, and all terms with their counts and first places, in order of id.

    Texts meet their document's others before they are cut, so that its terms
    stay where they are. A first place is one number, of id and place: the
    least of them is kept in a hash table, where a pair would need a sort.
    """
    own = _terms(_spread(texts.select("document_id", "text"), "document_id"), "document_id").select("document_id", "term").distinct()
    place = (F.col("id").cast("decimal(20,0)") * F.lit(10**10).cast("decimal(11,0)")).alias("place")  # below it there is room for each i
    counts = _terms(texts, place).groupBy("term").agg(F.count("*").alias("count"), F.min(F.col("place") + F.col("i")).alias("first"))
    return own, counts


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys to a fixed number of partitions: few bytes, but much work for each row."""
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def suggest(probes: DataFrame, document_terms: DataFrame, counts: DataFrame, limit: int = 5) -> DataFrame:
    """(document_id, probe) -> term, score, place: similar terms of the probe's document, weighted by their counts everywhere; of equal ones the first remembered.

    Terms hold no white space, so they are folded by lower() alone; lengths drop
    pairs before the edit distance, and that stops at its bound. Terms as
    :func:`remember` gives them are not shuffled again.
    """
    asked = probes.where(F.trim("probe") != "").withColumn("target", F.lower(F.trim("probe")))
    near = asked.join(document_terms.withColumn("low", F.lower("term")), "document_id").where(F.col("term") != F.col("target"))
    near = near.withColumn("n", F.greatest(F.length("target"), F.length("low"))).withColumn("most", F.floor((1 - SIMILAR) * F.col("n") + 1e-9).cast("int"))
    near = near.where(F.abs(F.length("target") - F.length("low")) <= F.col("most")).withColumn("distance", F.expr("levenshtein(target, low, most)")).where("distance >= 0")
    near = near.withColumn("similarity", 1 - F.col("distance") / F.col("n").cast("double")).where(F.col("similarity") >= SIMILAR).join(counts, "term")
    scored = near.withColumn("score", F.col("similarity") * (1 + F.least(F.col("count"), F.lit(10)) / 20.0))
    order = Window.partitionBy("document_id", "probe").orderBy(F.col("score").desc(), "first")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("document_id", "probe", "term", "score", "place")


def evaluated(asked: DataFrame, suggested: DataFrame) -> DataFrame:
    """(document_id, probe, candidate, support, margin) with allowed: the candidate is suggested, the support 0.5 or more, the margin 0.35 or less."""
    hits = suggested.select("document_id", "probe", F.col("term").alias("candidate"), F.lit(True).alias("suggested")).distinct()
    found = asked.join(hits, ["document_id", "probe", "candidate"], "left")
    return found.withColumn("allowed", F.coalesce("suggested", F.lit(False)) & (F.col("support") >= 0.5) & (F.col("margin") <= 0.35)).drop("suggested")


#: Terms and probes of a block, all lengths together (a large tree is shared more), probes that are followed at once, and cells of edit distances that a task holds at once.
BLOCK_TERMS, BLOCK_PROBES, TOGETHER, CELLS = 2_000_000, 16_000, 4096, 1 << 24


def _points(texts: np.ndarray, length: int) -> np.ndarray:
    """Code points of strings of one length, a row for each."""
    return np.array(["".join(texts)]).view(np.uint32).reshape(-1, length)


def _tree(terms: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of a beginning, of sorted code points: its last letters, and for each beginning one shorter its first and its number among these."""
    new = np.logical_or.accumulate(np.vstack([np.ones((1, terms.shape[1]), bool), terms[1:] != terms[:-1]]), axis=1)
    out, above = [], np.zeros(1, np.int64)
    for i in range(terms.shape[1]):
        starts = np.flatnonzero(new[:, i])
        first = np.searchsorted(starts, above)
        out.append((terms[starts, i], first.astype(np.int32), np.diff(first, append=len(starts)).astype(np.int32)))
        above = starts
    return out


def _near(probes: np.ndarray, tree: list, most: int, half: int, early: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probe, term, edits) of all pairs with ``most`` edits at most, of which ``early`` at most fall on the term's first ``half`` letters.

    Probes go down the tree of the terms' beginnings together. Of a row of the
    table of distances only the cells are held that such a pair can pass, and a
    beginning that no such pair can have is left.
    """
    size, n, m = len(probes), probes.shape[1], len(tree)
    spare = (most - abs(n - m)) // 2
    shifts = np.arange(min(0, n - m) - spare, max(0, n - m) + spare + 1)  # by how much a probe's place may be ahead of a term's
    least = np.abs(n - m - shifts)[:, None]  # edits that the lengths left over need
    far, letters = most + 1, np.ascontiguousarray(probes.T)
    who, node = np.arange(size, dtype=np.int32), np.zeros(size, np.int32)
    cells = np.repeat(np.where(shifts < 0, far, np.minimum(shifts, far)).astype(np.int16)[:, None], size, axis=1)
    for at, (letter, first, below) in enumerate(tree):
        count = below[node]
        if size > 1 and int(count.sum()) * len(shifts) > CELLS:
            parts = [_near(some, tree, most, half, early) for some in (probes[: size // 2], probes[size // 2 :])]
            parts[1] = (parts[1][0] + size // 2, *parts[1][1:])
            return tuple(map(np.concatenate, zip(*parts)))
        came = np.repeat(np.arange(len(node), dtype=np.int32), count)
        node = np.arange(len(came), dtype=np.int32) + np.repeat(first[node] - np.cumsum(count, dtype=np.int32) + count, count)
        who, own, cells = who[came], letter[node], cells[:, came]
        for k, shift in enumerate(shifts):
            place = at + shift  # of the probe's letter that stands across
            if not -1 <= place < n:
                cells[k] = far
                continue
            left = cells[k] + (letters[place][who] != own) if place >= 0 else np.full(len(who), far, np.int16)
            if k + 1 < len(shifts):
                np.minimum(left, cells[k + 1] + 1, out=left)
            if k:
                np.minimum(left, cells[k - 1] + 1, out=left)
            cells[k] = left
        if at < half:
            cells[cells > early] = far
        if at == half - 1:  # what a probe has more behind these letters is not theirs
            for k in range(1, len(shifts)):
                if at + shifts[k] < n:
                    np.minimum(cells[k], cells[k - 1] + 1, out=cells[k])
        cells[cells > most - least] = far
        kept = np.flatnonzero((cells < far).any(axis=0))
        who, node, cells = who[kept], node[kept], cells[:, kept]
    return who, node, cells[n - m - shifts[0]]


def _pairs(probes: list[str], terms: list[str], at_least: float) -> Iterator[pd.DataFrame]:
    """probe, term, distance of the pairs among probes and terms of one length.

    Of a pair's edits, either half of them at most fall on the term's first
    letters, or fewer than half on its last: the tree of beginnings finds the
    former, that of reversed terms the latter, and the smaller number is right.
    """
    m, terms = len(terms[0]), np.sort(np.array(terms, dtype=str)).astype(object)
    points = _points(terms, m)
    order = np.lexsort(points[:, ::-1].T[::-1])  # by last letters
    half, trees = (m + 1) // 2, (_tree(points), _tree(points[order][:, ::-1]))
    by_length: dict[int, list[str]] = {}
    for probe in sorted(probes):
        by_length.setdefault(len(probe), []).append(probe)
    for n, own in by_length.items():
        most = math.floor((1 - at_least) * max(n, m) + 1e-9)
        for at in range(0, len(own), TOGETHER):
            some = np.array(own[at : at + TOGETHER], dtype=object)
            asked = _points(some, n)
            who, term, edits = _near(asked, trees[0], most, half, most // 2)
            if most:
                back = _near(asked[:, ::-1], trees[1], most, m - half, (most - 1) // 2)
                who, term, edits = np.concatenate([who, back[0]]), np.concatenate([term, order[back[1]]]), np.concatenate([edits, back[2]])
            by = np.lexsort((edits, term, who))
            who, term, edits = who[by], term[by], edits[by]
            first = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (term[1:] != term[:-1]))[: len(who)])
            yield pd.DataFrame({"probe": some[who[first]], "term": terms[term[first]], "distance": edits[first].astype(np.int32)})


def fuzzy_join(probes: DataFrame, memory: DataFrame, at_least: float = SIMILAR) -> DataFrame:
    """(probe) x (term) -> probe, term, distance, for pairs at least so similar, without comparing all pairs.

    Both sides are deduplicated and dealt into blocks, terms of one length to a
    block; blocks of probes meet blocks of terms whose length theirs allow.
    Where they meet, the terms are trees of their beginnings and of their ends
    (after Shang and Merrettal, "Tries for approximate string matching", 1996),
    which probes go down while half of the allowed edits last, and then while
    all do. The number of blocks follows the number of strings, so a task holds
    a bounded part of each side, whatever their sizes.
    """
    spark, path = probes.sparkSession, fresh_folder(probes.sparkSession, "fuzzy")
    probes.select("probe").distinct().withColumn("n", F.length("probe")).where("n > 0").write.parquet(f"{path}/probes")
    memory.select("term").distinct().withColumn("m", F.length("term")).where("m > 0").write.parquet(f"{path}/terms")
    left, right = spark.read.schema("probe string, n int").parquet(f"{path}/probes"), spark.read.schema("term string, m int").parquet(f"{path}/terms")
    rows, columns = -(-left.count() // BLOCK_PROBES) or 1, -(-right.count() // BLOCK_TERMS) or 1
    # A longer term of length L allows (1 - s) L edits, so L <= n / s.
    lengths = F.sequence(F.ceil(F.col("n") * at_least - 1e-9).cast("int"), F.floor(F.col("n") / at_least + 1e-9).cast("int"))
    edits = F.floor((1 - at_least) * F.greatest("n", "m") + 1e-9)
    dealt = lambda name, count: F.pmod(F.xxhash64(name), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    keys, few = ["m", "row", "column"], 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(few, 8 * rows * columns)
    met = left.repartition(few).select("probe", "n", F.explode(lengths).alias("m"), dealt("probe", rows).alias("row")).where(F.abs(F.col("n") - F.col("m")) <= edits)
    met = met.select("probe", "m", "row", every(columns).alias("column")).repartition(parts, *keys).groupBy(*keys).agg(F.collect_list("probe").alias("probes"))
    held = right.select("term", "m", dealt("term", columns).alias("column")).select("term", "m", every(rows).alias("row"), "column")
    held = held.repartition(parts, *keys).groupBy(*keys).agg(F.collect_list("term").alias("terms"))
    blocks = met.hint("merge").join(held, keys).select("probes", "terms")

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some, terms in zip(batch["probes"], batch["terms"]):
                yield from _pairs(list(some), list(terms), at_least)

    return blocks.mapInPandas(pairs, "probe string, term string, distance int")
