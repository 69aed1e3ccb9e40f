"""Every query against the SQL that says the same."""

import os
import zlib

import numpy as np
import pytest

from anomalypool.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    cell = lambda x: None if x is None else float(x) if isinstance(x, (int, float, np.number, np.bool_)) else str(x)
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(cell, r)) for r in df.where(df.notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    own, other = rows(catalog.QUERIES[name](spark, SF).toPandas()), rows(sql.sql(catalog.ORACLE_SQL[name]).df())
    assert len(own) == len(other)
    for a, b in zip(own, other):
        assert list(a) == [x if isinstance(x, (str, type(None))) else pytest.approx(x, rel=1e-6) for x in b]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"compose_split", "legacy_samples"}))
def test_query_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_stable_rank_of_every_order(spark):
    """By zlib, on the whole table."""
    ids = [r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()]
    got = {r["o_orderkey"]: r["r"] for r in catalog.QUERIES["stable_rank"](spark, SF).collect()}
    assert len(ids) == len(set(ids)) and max(ids) > 2000
    assert got == {i: zlib.crc32(f"42|pick|{i}".encode()) / 2**32 for i in ids}


def test_queries_of_pools_run_at_the_defaults(spark, monkeypatch):
    assert catalog.QUERIES["gen_series"](spark, SF).count() == 2000
    assert sum(r["n"] for r in catalog.QUERIES["inject_families"](spark, SF).collect()) == 2000
    seen = []
    monkeypatch.setattr(catalog.real_pool, "build", lambda points, group, config: seen.append(config) or {"metadata": points})
    catalog.QUERIES["compose_split"](spark, SF)
    assert [c.pool_size for c in seen] == [2900]


def test_raw_files_hold_whole_recordings(spark, sql, monkeypatch):
    """Where a join by recording has just dealt the points and splits its large partitions, so that repartition() by recording counts as done."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k"}
    own |= {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.1"}
    before = {k: spark.conf.get(k, None) for k in own}
    points = catalog.written(catalog.tables.event_series(spark, SF).repartition(8), "points")
    names = catalog.written(points.select("recording").distinct(), "names")
    monkeypatch.setattr(catalog.tables, "event_series", lambda *_: points.join(names, "recording"))
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = rows(catalog.QUERIES["raw_files"](spark, SF).toPandas())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == rows(sql.sql(catalog.ORACLE_SQL["raw_files"]).df())
