"""The corpus queries with SQL equal it in DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from tidemark.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    own = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    assert own == sorted(tuple(map(str, r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall())
