import duckdb
import numpy as np
import pytest

from marginalia.llm import neardup, ngramjoin
from marginalia.llm.ngramjoin import JoinKernel, candidate_edges, join_ngrams, least_common, prefixes
from marginalia.llm.queries import ORACLE_SQL, QUERIES

from .cases import SCHEMA, documents, empty, frame
from .test_neardup import brute_force


def copies(seed, many=120):
    """Chains of ever more changed copies of texts of several lengths, texts that share passages, and copies that end early."""
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 4000, n)]
    passage = word(60)
    bases = [word(n) for n in (12, 60, 200)]
    rows = []
    for i in range(many):
        base = list(bases[i % 3])
        for k in rng.choice(len(base), min(len(base), int(rng.integers(0, 4))), replace=False):
            base[k] = f"x{rng.integers(10**6)}"
        if i % 7 == 0:
            bases[i % 3] = list(base)
        kind = i % 5
        text = base + passage if kind == 1 else base[: len(base) - int(rng.integers(0, len(base) // 5))] if kind == 2 else word(40) + passage if kind == 3 else base
        rows.append((2000 + i, " ".join(text), None))
    return rows


@pytest.mark.parametrize(("words", "percent", "small"), [(5, 80, False), (3, 60, False), (5, 80, True), (2, 90, True)])
def test_all_pairs(spark, monkeypatch, words, percent, small):
    if small:  # tokens are frequent soon, families large
        monkeypatch.setattr(ngramjoin, "HOT_ROWS", 3)
        monkeypatch.setattr(ngramjoin, "ONE_IN", 2)
        monkeypatch.setattr(ngramjoin, "FAMILY_NODES", 9)
        monkeypatch.setattr(neardup, "PIVOTS", 3)
    rows = documents() + copies(words) + [(2003, "another text of an id that has one already " * 3, None), (2004, documents()[1][1], None)]
    expected = brute_force(rows, words, percent)
    got = join_ngrams(frame(spark, rows).repartition(5), words=words, percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    found = got.collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == expected
    assert all(r.component_id is None for r in found if r.doc_id is None)
    assert len(set(expected.values())) < len(expected) - 60


def test_filters_lose_no_pair(spark):
    """Every pair that is similar enough hangs together by candidate edges; sets that only share a passage mostly do not."""
    rng = np.random.default_rng(4)
    sets = {}
    for i in range(150):
        if i % 3 and i > 3:
            own = set(sets[int(rng.integers(i))])
            own = set(rng.choice(sorted(own), int(len(own) * rng.uniform(0.8, 1)), replace=False).tolist()) | set(rng.integers(0, 5000, int(rng.integers(0, 12))).tolist())
        else:
            own = set(rng.integers(0, 5000, int(rng.integers(1, 120))).tolist())
        sets[i] = own
    count = {}
    for own in sets.values():
        for t in own:
            count[t] = count.get(t, 0) + 1
    rows = [(int(t), i, len(own), count[t]) for i, own in sets.items() for t in own if count[t] > 1]
    for percent in (60, 80, 95):
        entries = prefixes(spark.createDataFrame(rows, "token long, node long, size long, n long"), percent).cache()
        up = list(range(150))

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        edges = candidate_edges(entries, entries.count()).collect()
        assert len(edges) <= entries.count()
        for e in edges:
            up[root(e.u)] = root(e.v)
        near = [(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        assert near and all(root(a) == root(b) for a, b in near)
    assert least_common(np.asarray([1, 5, 6]), 80).tolist() == [1, 4, 5]


def test_kernel_agrees_with_sets():
    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 12, rng.integers(1, 30))) for _ in range(60)]
    sets = [frozenset(zip(t.split(), t.split()[1:])) or frozenset([t]) for t in texts]
    kernel = JoinKernel(2, 30)
    rows = kernel.read(texts)
    near = kernel.among(rows)
    alike = lambda i, j: 100 * len(sets[i] & sets[j]) >= 30 * len(sets[i] | sets[j])
    assert all(near(i)[j - i - 1] == alike(i, j) for i in range(60) for j in range(i + 1, 60))
    across = list(kernel.between(kernel.read(texts[:25]), kernel.read(texts[25:])))
    assert all(across[i][j] == alike(i, 25 + j) for i in range(25) for j in range(35))


def test_odd_tables(spark):
    assert join_ngrams(empty(spark)).count() == 0
    names = ["doc_id", "text", "node", "token", "size", "n", "a.b", "low", "own", "reach"]
    rows = [(i, "one text that all of these rows have in common", 1, 2, 3, 4, "x", 5, 6, 7) for i in range(3)]
    assert {tuple(r) for r in join_ngrams(spark.createDataFrame(rows, names)).collect()} == {(i, 6, 0) for i in range(3)}
    nothing = join_ngrams(spark.createDataFrame([(1, None, None), (2, " \n", None), (None, "a b c d e f", None)], SCHEMA)).collect()
    assert sorted((r.n_shingles, r.component_id) for r in nothing if r.doc_id) == [(0, 1), (0, 2)] and len(nothing) == 3


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    expected = duck.execute(ORACLE_SQL["op11_ngram_join"]).fetchall()
    assert sorted(tuple(r) for r in QUERIES["op11_ngram_join"](spark, sf).collect()) == sorted(expected)
