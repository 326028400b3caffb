"""The training-data queries that SQL can express, against DuckDB on the given tables."""

import os

import duckdb
import pytest

from vigilog.llm import queries

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are absent")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.QUERIES[name](spark, DATA)
    result = con.execute(queries.ORACLE_SQL[name])
    theirs = [c[0] for c in result.description]
    columns = sorted(df.columns)
    assert sorted(theirs) == columns
    places = [theirs.index(c) for c in columns]
    expected = sorted(str(tuple(row[i] for i in places)) for row in result.fetchall())
    assert expected and sorted(str(tuple(r)) for r in df.select(*columns).collect()) == expected
