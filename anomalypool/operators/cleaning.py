"""From raw cells to clean series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import binary_label, number_or_null


def coerced(raw: DataFrame) -> DataFrame:
    """value as a number or null, label as 0 or 1."""
    return raw.withColumns({"value": number_or_null(F.col("value")), "label": binary_label(F.col("label"))})


def filled(df: DataFrame, key: str = "recording", position: str = "pos") -> DataFrame:
    """Gaps take the last value before them in their recording."""
    so_far = W.partitionBy(key).orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("value", F.last("value", ignorenulls=True).over(so_far))


def cleaned(df: DataFrame, key: str = "recording", position: str = "pos") -> DataFrame:
    """Coerced and filled rows from the first value on, positions counted anew from 0; recordings without a value are gone."""
    rows = filled(coerced(df), key, position).filter("value IS NOT NULL")
    first = F.min(position).over(W.partitionBy(key))
    return rows.withColumn(position, F.col(position) - first)
