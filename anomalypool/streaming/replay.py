"""The cheap scan over a stream: tumbling windows of events as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of Parquet files of events in a folder."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and spread of each event type in tumbling windows; a window closes when events are `late` past its end. Works on a batch as well."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("max")).select(
        F.col("w.start").alias("start"), "event_type", "n", "mean", "std", "max"
    )
