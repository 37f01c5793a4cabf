"""Every registered query against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from marginalia import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(frame):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
            return None
        return f"{float(x):.9g}" if isinstance(x, (int, float)) or getattr(getattr(x, "dtype", None), "kind", "") in "iuf" and getattr(x, "dtype", None) is not None else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(value, r))) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, duck, name):
    got, expected = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs_without_sql(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
