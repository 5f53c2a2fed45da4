"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from lodestat.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, str)):
        return v
    return round(float(v), 6) if not isinstance(v, int) and hasattr(v, "__float__") else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    want = sorted((tuple(plain(v) for v in r) for r in cursor.fetchall()), key=key)
    assert len(got) == len(want) and got
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 1e-5 * max(1, abs(x))) for x, y in zip(a, b, strict=True)), (a, b)


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(catalog.SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
