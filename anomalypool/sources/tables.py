"""Series in the star-schema tables: adapters that give (recording, pos, value, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import with_positions
from ..operators.profile import exact_percentile


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _above(rows: DataFrame, share: float) -> DataFrame:
    """label: whether the value is above that quantile of its recording."""
    limits = rows.groupBy("recording").agg(exact_percentile("value", share).alias("_limit"))
    return rows.join(limits, "recording").withColumn("label", (F.col("value") > F.col("_limit")).cast("tinyint")).select("recording", "pos", "value", "label")


def event_series(spark: SparkSession, sf_dir: str, share: float = 0.998) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("recording"), "ts", "event_id", "value")
    return _above(with_positions(rows, "recording", [F.col("ts"), F.col("event_id")]), share)


def price_series(spark: SparkSession, sf_dir: str, share: float = 0.998) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("recording"), *order, F.col("l_extendedprice").alias("value"))
    return _above(with_positions(rows, "recording", [*map(F.col, order), F.col("value")]), share)


def vector_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("recording"), F.posexplode("embedding").alias("pos", "value"))
    return rows.select("recording", F.col("pos").cast("long"), F.col("value").cast("double"), F.lit(0).cast("tinyint").alias("label"))


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums of prices, in cents so that they don't depend on the order of adding, per flag; pos counts days with any."""
    from pyspark.sql import Window as W

    day = F.to_date("l_shipdate")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("recording"), day.alias("day")).agg((F.sum(cents) / 100.0).alias("value"))
    return sums.select("recording", (F.row_number().over(W.partitionBy("recording").orderBy("day")) - 1).cast("long").alias("pos"), "value", F.lit(0).cast("tinyint").alias("label"))


def order_samples(spark: SparkSession, sf_dir: str, first: str = "1-URGENT") -> DataFrame:
    """Orders as samples of customers (recordings) of machines, positive if of the first priority."""
    o = table(spark, sf_dir, "orders")
    customer = F.col("o_custkey").cast("string")
    return o.select(
        F.lit("orders").alias("dataset"), customer.alias("recording"), F.concat(F.lit("m"), (F.col("o_custkey") % 97).cast("string")).alias("machine"),
        F.concat_ws("", F.lit("R__orders__"), customer, F.lit("_chunk"), F.col("o_orderkey").cast("string")).alias("series_id"), (F.col("o_orderpriority") == first).cast("int").alias("y_i"), F.col("o_orderkey").alias("start"),
    )
