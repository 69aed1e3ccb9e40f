"""Every training-data query that SQL can express, against its SQL."""

import os

import pytest

from anomalypool.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    other = con.sql(queries.ORACLE_SQL[name])
    own = queries.QUERIES[name](spark, SF).select(*other.columns)
    assert sorted(tuple(r) for r in own.collect()) == sorted(other.fetchall())
