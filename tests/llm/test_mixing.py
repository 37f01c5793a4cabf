from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.llm.mixing import mix_sources, mixed_documents

from .cases import documents, empty, frame


def water_fill(sizes, weights, total):
    """Targets by resharing excess until none is above."""
    target, free = dict.fromkeys(sizes, 0.0), {s for s in sizes if sizes[s]}
    left = total
    while free and left > 1e-9:
        share = left / sum(weights[s] for s in free)
        left, full = 0.0, set()
        for s in free:
            target[s] += share * weights[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
        free -= full
    return target


def test_targets_and_takes(spark):
    rows = mix_sources(frame(spark).withColumn("taken", F.lit("clash"))).collect()
    assert len(rows) == len(documents())
    sizes = defaultdict(int)
    for d, text, source in documents():
        sizes[source] += len((text or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    expected = water_fill(sizes, weights, 1.5 * sum(sizes.values()))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - expected[s]) <= largest[s] for s in sizes)
    assert rows == mix_sources(frame(spark).withColumn("taken", F.lit("clash")).repartition(7)).orderBy("doc_id").collect() or sorted(map(str, rows)) == sorted(map(str, mix_sources(frame(spark).withColumn("taken", F.lit("clash")).repartition(7)).collect()))


def test_many_small_documents_meet_the_target(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 9 + 1).cast("int"))).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    got = mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r.t - r.target) <= 5 for r in got)


def test_heavier_weights_are_taken_more_often(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("one").alias("source"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.1).alias("q"))
    twice = {r.even: r.n for r in mix_sources(docs, weight=F.col("q"), share=1.3).where("taken > size").groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(F.count("*").alias("n")).collect()}
    assert twice[True] > 3 * twice[False]


def test_the_mix_itself(spark):
    rows = mix_sources(frame(spark)).collect()
    out = mixed_documents(frame(spark))
    assert out.columns == frame(spark).columns
    assert out.count() == sum(r.taken // r.size for r in rows if r.size)
    assert mix_sources(empty(spark)).count() == 0 and mixed_documents(empty(spark)).count() == 0
