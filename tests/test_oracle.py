"""Every registered log query against its SQL in DuckDB, on the given tables."""

import os

import duckdb
import pytest

from vigilog.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    result = duck.execute(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    theirs = [c[0] for c in result.description]
    assert sorted(theirs) == columns
    places = [theirs.index(c) for c in columns]
    expected = sorted(str(tuple(row[i] for i in places)) for row in result.fetchall())
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
