import numpy as np
import pytest

from marginalia.llm.topk import LISTS, remaining, top_k


def test_an_id_with_several_vectors(spark):
    # Parts of id 50's rows, added up, would pass for a score of 40; id 60 has 16, each row of 50 only 10.
    rows = [(50, [10.0, 0.0, 0.0, 0.0]), (50, [0.0, 10.0, 0.0, 0.0]), (50, [0.0, 0.0, 10.0, 0.0]), (50, [0.0, 0.0, 0.0, 10.0]), (60, [4.0] * 4), (70, [0.0] * 4)]
    query = [(1, [1.0] * 4)]
    got = lambda k: [(r["rank"], r.vec_id, r.score >> 16) for r in top_k(*(spark.createDataFrame(x, "vec_id long, embedding array<float>") for x in (query, rows)), k).orderBy("rank").collect()]
    assert got(1) == [(1, 60, 16)]
    assert got(3) == [(1, 60, 16), (2, 50, 10), (3, 50, 10)]


@pytest.mark.parametrize("seed", range(5))
def test_fewer_scores_are_resolved(seed):
    """What remains after phase two holds the best, and is less than all; far blocks are not read."""
    rng = np.random.default_rng(seed)
    q, c = (np.floor(256 * rng.normal(size=(n, 32))) for n in (20, 3000))
    c[:200] *= 3
    whole = q @ c.T
    k = 5
    parts = np.stack([q[:, n * 8 : n * 8 + 8] @ c[:, n * 8 : n * 8 + 8].T for n in range(LISTS)], 1)
    lows = parts.min(2)
    cut = np.sort(whole, axis=1)[:, -k] - lows.sum(1) - rng.random(20) * 1e5  # some bound below the k-th best score, from the lists' lowest
    left, read = remaining(q, c, cut, lows, LISTS)
    assert all(left[i, np.argsort(-whole[i])[:k]].all() for i in range(20))
    assert left.sum() < 0.5 * whole.size and read <= parts.size
    near, read = remaining(q, c * 1e-3, cut, np.zeros_like(lows), LISTS)
    assert not near.any() and read < parts.size / 4
    assert remaining(q, c, np.full(20, np.nan), lows, LISTS)[0].all()


def test_repeated_ids_at_random(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i) % 40, (rng.normal(size=8) * (rng.random(8) < 0.5)).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    floors = lambda v: np.floor(256 * np.asarray(v, np.float32).astype(float))
    asked = {}
    for i, v in rows:
        asked[i] = min(asked.get(i, v), v)
    for k in (1, 7):
        got = {}
        for r in top_k(frame, frame, k).collect():
            got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
        for i, v in asked.items():
            expected = sorted((-int(floors(v) @ floors(u)), j) for j, u in rows if j != i)[:k]
            assert [x[1:] for x in sorted(got[i])] == expected
