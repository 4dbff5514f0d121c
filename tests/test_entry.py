"""Every query with SQL equals it in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
ENGINE = __import__("tidemark.queries", fromlist=["x"])


def canonical(v):
    if isinstance(v, float):
        return repr(round(v, 8))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(ENGINE.SQL))
def test_equals_sql(spark, duck, name):
    df = ENGINE.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    own = sorted(tuple(canonical(v) for v in r) for r in df.select(*columns).collect())
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ENGINE.SQL[name]})").fetchall()
    assert own == sorted(tuple(canonical(v) for v in r) for r in want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "confidence" in df.columns


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
