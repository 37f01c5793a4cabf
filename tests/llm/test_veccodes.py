import math
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from marginalia.llm.queries import ORACLE_SQL, QUERIES
from marginalia.llm.veccodes import Bounds, compress_vectors, first_codes, next_codes, squares

TYPE = "vec_id long, embedding array<float>, label int"


def plainly(rows, parts=8, entries=16, rounds=6):
    """Lloyd rounds over lists of Python's integers, every distance computed."""
    kept = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(1, max(len(v) for _, v, _ in kept)) // parts)
    whole = lambda v: [max(-(2**90), min(2**90, math.floor(4096 * x))) for x in v] + [0] * (parts * width - len(v))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [whole(v) for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = [near(v[p], book) for v in cut]
            for e in range(len(book)):
                members = [v[p] for v, c in zip(cut, own) if c == e]
                if members:
                    book[e] = [sum(x) // len(members) for x in zip(*members)]
    digest = sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, label), v in zip(kept, cut):
        code = [near(x, book) for x, book in zip(v, books)]
        error = min(2**63 - 1, sum(far(x, book[c]) for x, book, c in zip(v, books, code)))
        by_label[label] = min(2**63 - 1, by_label.get(label, 0) + error)
        out.append((i, "".join(f"{c:02x}" for c in code), error, label))
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in out), key=repr)


def rows_of(seed, n=400, dim=24):
    rng = np.random.default_rng(seed)
    some = [rng.normal(size=dim).round(1) for _ in range(40)]
    rows = [(i, (some[rng.integers(40)] + rng.choice([0, 0, 0.1], dim)).astype(np.float32).tolist(), [1, 2, None][i % 3]) for i in rng.permutation(n).tolist()]
    return rows + [(1000, None, 1), (1001, [1.0, None], 2), (1002, [float("nan")] * dim, 3), (1003, [float("-inf")] * dim, 3), (None, [0.5] * dim, None), (1004, [], 7), (1005, [0.25] * 5, 7), rows[3], rows[3], (rows[5][0], [0.0] * dim, 9)]


@pytest.mark.parametrize(("seed", "dim"), [(1, 24), (2, 5), (3, 64)])
def test_plain_rounds(spark, seed, dim):
    rows, looked = rows_of(seed, dim=dim), []
    got = compress_vectors(spark.createDataFrame(rows, TYPE).repartition(3), looked=looked)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plainly(rows)
    assert max(looked[1:]) < looked[0] / 2  # the bounds rule most distances out


def test_ties_and_huge_components(spark):
    tied = [(i, [float(i % 3)] * 8 + [1.0] * 8, None) for i in range(60)]
    huge = [(i, [float(np.float32(x)) for x in (1e30, -1e30, 3e38, 1.0)] if i % 2 else [float(i)] * 4, i % 2) for i in range(40)]
    for rows in (tied, huge, tied[:5]):
        assert sorted((tuple(r) for r in compress_vectors(spark.createDataFrame(rows, TYPE)).collect()), key=repr) == plainly(rows)


def test_bounds_hold():
    """Bounds are on the right sides of the distances after every round, and codes are the nearest entries'."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3000, 3000, (500, 6))
    book = x[:16].copy()
    held = first_codes(x, book)
    for _ in range(5):
        new = np.stack([x[held.code == e].sum(0) // max(1, (held.code == e).sum()) if (held.code == e).any() else book[e] for e in range(16)])
        held = next_codes(x, new, Bounds(held.code, held.upper.astype("<f4").astype(float) * (1 + 2**-20), held.lower.astype("<f4").astype(float) * (1 - 2**-20)), np.sqrt(squares(new, book).astype(float)) * (1 + 2**-20))
        book = new
        true = np.sqrt(np.stack([squares(x, e) for e in book], 1))
        assert (held.code == true.argmin(1)).all() and (held.lower <= true).all() and (held.upper >= true.min(1)).all()


def test_odd_tables(spark):
    assert compress_vectors(spark.createDataFrame([], TYPE)).count() == 0
    assert compress_vectors(spark.createDataFrame([(1, None, 2)], TYPE)).count() == 0
    out = compress_vectors(spark.createDataFrame([(1, [1.0, 2.0], "a", 5, 6, 7)] * 2 + [(2, [1.0, 2.0], None, 5, 6, 7)], "vec_id long, embedding array<double>, label string, n int, code int, `a.b` int")).collect()
    assert [(r.error, r.label_error) for r in out] == [(0, 0)] * 3 and {r.code for r in out} == {"00" * 8}


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op13_vector_codes"](spark, sf).collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    cursor = duck.execute(ORACLE_SQL["op13_vector_codes"])
    names = [d[0] for d in cursor.description]
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(cursor.fetchall())
