"""Every query that has SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

from strataquery.plans import operations, registry

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return con


QUERIES, SQL = registry.QUERIES | operations.QUERIES, registry.SQL | operations.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    frame = QUERIES[name](spark, AT)
    columns = sorted(frame.columns)
    mine = sorted(repr([r[c] for c in columns]) for r in frame.collect())
    result = duck.sql(SQL[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    assert mine == sorted(repr([r[i] for i in places]) for r in result.fetchall())
