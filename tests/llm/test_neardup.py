import numpy as np
import pytest

from marginalia.llm import neardup
from marginalia.llm.graph import components
from marginalia.llm.neardup import common_counts, cross_counts, drop_near_duplicates, near_duplicates, sketch_distance, spanning_forest

from .cases import documents, empty, frame


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_force(rows, words, percent):
    sets = {}
    for d, text, *_ in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingles(text, words))
    ids = sorted(sets)
    up = {d: d for d in ids}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 85, None), (5, 80, None), (3, 85, 9)])
def test_all_pairs(spark, monkeypatch, words, percent, block):
    if block:  # pivots and pairs of blocks, as in very large groups
        for name in ("BUCKET_BLOCK", "FAMILY_NODES"):
            monkeypatch.setattr(neardup, name, block)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = documents()
    for i in range(150):  # one chain of ever more changed copies, and copies of the first
        text = list(base)
        for k in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            text[k] = f"x{rng.integers(1000)}"
        if i % 3 == 0:
            base = list(text)
        rows.append((2000 + i, " ".join(text), None))
    expected = brute_force(rows, words, percent)
    got = near_duplicates(frame(spark, rows), words=words, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == expected[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    sizes = {d: len(shingles(t, words)) for d, t, *_ in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in got)


def test_filtering_keeps_columns(spark):
    rows = frame(spark).withColumnRenamed("source", "kept")
    out = drop_near_duplicates(rows)
    assert out.columns == rows.columns
    ids = {r.doc_id for r in out.collect()}
    assert {None, 1001, 1002, 1003, 1004} <= ids and 1005 not in ids
    assert near_duplicates(empty(spark)).count() == 0 and drop_near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))] + [(7, 7)]
    up = {n: n for e in edges for n in e}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_block_kernels():
    rng = np.random.default_rng(2)
    sets = [rng.choice(300, rng.integers(1, 120), replace=False).astype(np.uint64) for _ in range(40)]
    got = common_counts(np.concatenate(sets), np.repeat(np.arange(40), [len(s) for s in sets]), 40)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(i + 1, 40))
    for n in (5, 30):
        parts = [np.concatenate([np.sort(s) for s in own]) for own in (sets[:n], sets[n:])]
        own = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (sets[:n], sets[n:])]
        across = cross_counts(parts[0], own[0], n, parts[1], own[1], 40 - n)
        assert all(across[i, j] == len(np.intersect1d(sets[i], sets[n + j])) for i in range(n) for j in range(40 - n))
    near = rng.random((30, 30)) < 0.05
    forest = spanning_forest(lambda i: near[i, i + 1 :], 30)
    assert len(forest) < 30 and all(near[i, j] for i, j in forest)
    assert 60 < sketch_distance(0.85, 180, 512) < 140


def test_recall_on_documents(spark):
    """All linked pairs of the smallest table's documents, whole and after line dedup, by brute force."""
    from marginalia.llm.linededup import dedup_lines

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for table, words, percent in ((docs, 3, 85), (dedup_lines(docs).select("doc_id", "text"), 5, 80)):
        rows = [tuple(r) for r in table.collect()]
        expected = brute_force(rows, words, percent)
        assert {r.doc_id: r.component_id for r in near_duplicates(table, words=words, percent=percent).collect()} == expected
    assert len(set(expected.values())) < len(expected)


def test_clashing_names(spark):
    names = ["doc_id", "text", "gone_id", "own_id", "row", "a.b", "node", "group", "value"]
    rows = [(i, "one text that all of these rows have in common", 1, 2, 3, "x", 4, 5, "y") for i in range(3)]
    out = drop_near_duplicates(spark.createDataFrame(rows, names))
    assert out.columns == names and [tuple(r) for r in out.collect()] == rows[:1]
