"""Pools on disk: points, metadata and a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(root: str, group: str, what: str, full: bool) -> str:
    return f"{root}/{group}{'_full' if full else ''}{what}.parquet"


def write_pool(points: DataFrame, metadata: DataFrame, root: str, group: str, full: bool = False) -> None:
    """Points by ranges of series, in order, so that a reader of some series skips most files; then metadata."""
    points.repartitionByRange("series_id", "time_index").sortWithinPartitions("series_id", "time_index").write.mode("overwrite").parquet(_path(root, group, "", full))
    metadata.write.mode("overwrite").parquet(_path(root, group, "_metadata", full))


def load_pool(spark: SparkSession, root: str, group: str, full: bool = False) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(_path(root, group, "", full)), spark.read.parquet(_path(root, group, "_metadata", full))


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """A small JSON document, indented."""
    write_text(spark, json.dumps(document, indent=2, ensure_ascii=False, default=str), path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file in a folder of that name."""
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_rows(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)
