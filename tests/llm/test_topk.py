import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import topk
from marginalia.llm.topk import top_k


def plainly(queries, rows, k):
    whole = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    floors = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    asked = {}
    for i, v in queries:
        if i is not None and whole(v):
            asked[i] = min(asked.get(i, v), v)
    out = {}
    for i, v in asked.items():
        score = lambda u, v=v: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(floors(v), floors(u)))))
        out[i] = sorted(((-score(u), j) for j, u in rows if j is not None and j != i and whole(u)))[:k]
    return out


@pytest.mark.parametrize("k", [1, 5])
def test_all_scores(spark, k):
    rng = np.random.default_rng(k)
    rows = [(int(i), rng.normal(size=rng.choice([3, 8, 8, 8])).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [9.0] * 8), (304, []), (305, [1e30] * 8), (306, [-1e30] * 8)]
    rows += [rows[4], rows[4], (50, [0.5] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = [r for r in rows if r[0] is not None and r[0] % 10 == 0] + [(None, [1.0])]
    got = {}
    for r in top_k(spark.createDataFrame(queries, "vec_id long, embedding array<float>"), frame, k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    expected = plainly(queries, rows, k)
    assert {i: [x[1:] for x in sorted(own)] for i, own in got.items()} == {i: own for i, own in expected.items() if own}


def test_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 2.0], 7)], "vec_id long, embedding array<float>, score int")
    assert top_k(none, one).count() == 0 and top_k(one, none).count() == 0 and top_k(one, one).count() == 0


def test_queries_are_not_broadcast(spark):
    """Copies of the queries, one for each partition, are never gathered on the driver, however small the planner takes them to be."""
    blocks = spark.createDataFrame([(b, 1, 1, b"", b"") for b in range(6)], "block long, n long, width long, ids binary, flat binary")
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "vec_id long, vector array<double>")
    met = topk.meeting(blocks, rows, F.struct("vec_id", "vector"), 2, 4)
    found = {}
    for r in met.collect():
        found.setdefault(r.block, []).extend(q.vec_id for q in r.queries)
    assert len(found) == 6 and all(sorted(x) == list(range(10)) for x in found.values())
    text = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text
