"""What every pool must satisfy, as a table of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.scalars import finite


class PoolError(ValueError):
    pass


def check_schema(points: DataFrame, metadata: DataFrame) -> None:
    """Columns and types of a pool; a PoolError names what is missing or of another type."""
    wrong = [f.name for f in schema.POINTS if f.name not in points.columns or points.schema[f.name].dataType != f.dataType]
    lost = sorted({"series_id", "length", "num_point_anomalies", "y_i"} - set(metadata.columns))
    if wrong or lost:
        raise PoolError(f"points: {wrong}; metadata: {lost}")


def violations(points: DataFrame, metadata: DataFrame, lengths: tuple[int, int] | None = None, max_ratio: float | Column | None = None) -> DataFrame:
    """One row a check: (check, violations). The points are read once. max_ratio may be a column over metadata, a cap for each row."""
    seen = points.groupBy("series_id").agg(
        F.count("*").alias("_n"), F.sum("label").alias("_a"), F.min("time_index").alias("_lo"), F.max("time_index").alias("_hi"), F.sum("time_index").alias("_t"),
        F.sum((~finite(F.col("value")) | F.col("value").isNull()).cast("int")).alias("_inf"), F.sum((~F.col("label").isin(0, 1) | F.col("label").isNull()).cast("int")).alias("_lab"),
    ).withColumnRenamed("series_id", "_sid")
    repeated = metadata.groupBy("series_id").agg(F.count("*").alias("_c")).select(F.col("series_id").alias("_rid"), "_c")
    joined = metadata.join(repeated, F.col("series_id") == F.col("_rid"), "left").join(seen, F.col("series_id") == F.col("_sid"), "full")
    bad = {
        "unique_series": F.col("_c") > 1, "finite_values": F.col("_inf") > 0, "binary_labels": F.col("_lab") > 0, "metadata_has_data": F.col("_sid").isNull(), "data_has_metadata": F.col("series_id").isNull(),
        "length_matches": F.col("length") != F.col("_n"), "anomalies_match": F.col("num_point_anomalies") != F.col("_a"), "label_matches": F.col("y_i") != (F.col("_a") > 0).cast("int"),
        "contiguous": (F.col("_lo") != 0) | (F.col("_hi") != F.col("_n") - 1) | (2 * F.col("_t") != F.col("_n") * (F.col("_n") - 1)),
    }
    if lengths is not None:
        bad["length_bounds"] = ~F.col("_n").between(*lengths)
    if max_ratio is not None:
        bad["anomaly_budget"] = F.col("_a") / F.col("_n") > max_ratio + 1e-9
    if "split" in metadata.columns:
        bad["known_split"] = F.col("series_id").isNotNull() & ~F.coalesce(F.col("split").isin("dev", "test"), F.lit(False))
    row = joined.agg(*[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n) for n, c in bad.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(0)).alias("violations")) for n in bad]))
    return row.select(pairs.alias("_p")).select("_p.*")


def validate(points: DataFrame, metadata: DataFrame, **limits) -> None:
    """Raise a PoolError that names what is violated; before anything is written."""
    check_schema(points, metadata)
    failed = {r["check"]: r["violations"] for r in violations(points, metadata, **limits).collect() if r["violations"]}
    if failed:
        raise PoolError(f"violations: {failed}")
