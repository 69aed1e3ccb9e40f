"""Ranking metrics and pool summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dataset_of
from .profile import exact_percentile


def auroc(scored: DataFrame, score: str = "score", truth: str = "y_i", by: str | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half. Scores are counted first, so only distinct ones are ordered."""
    from pyspark.sql import Window as W

    keys = [by] if by else []
    levels = scored.groupBy(*keys, score).agg(F.count("*").alias("_n"), F.sum(truth).alias("_p"))
    below = W.partitionBy(*keys).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    ranked = levels.withColumn("_rank", F.coalesce(F.sum("_n").over(below), F.lit(0)) + (F.col("_n") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("_rank") * F.col("_p")).alias("_s"), F.sum("_p").alias("_n1"), F.sum(F.col("_n") - F.col("_p")).alias("_n0"))
    area = (F.col("_s") - F.col("_n1") * (F.col("_n1") + 1) / 2) / (F.col("_n1") * F.col("_n0"))
    return sums.select(*keys, F.when((F.col("_n1") > 0) & (F.col("_n0") > 0), area).alias("auroc"))


def adjusted_rand(labelled: DataFrame, predicted: str = "predicted", truth: str = "y_i") -> DataFrame:
    """Adjusted Rand index from the contingency table."""
    pairs = lambda n: n * (n - 1) / 2
    cells = labelled.groupBy(predicted, truth).agg(F.count("*").cast("double").alias("n"))
    inner = cells.agg(F.sum(pairs(F.col("n"))).alias("_i"), F.sum("n").alias("_n"))
    a = cells.groupBy(predicted).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("_a"))
    b = cells.groupBy(truth).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("_b"))
    one = inner.join(F.broadcast(a)).join(F.broadcast(b))  # one row each
    chance = F.col("_a") * F.col("_b") / pairs(F.col("_n"))
    most = (F.col("_a") + F.col("_b")) / 2
    return one.select(F.when(most == chance, 1.0).otherwise((F.col("_i") - chance) / (most - chance)).alias("ari"))


def pool_summary(metadata: DataFrame, by: list[str]) -> DataFrame:
    return metadata.groupBy(*by).agg(
        F.count("*").alias("n_series"), F.avg("y_i").alias("positive_rate"), F.min("length").alias("min_length"), F.avg("length").alias("mean_length"), F.max("length").alias("max_length"),
        F.stddev_samp("length").alias("std_length"), F.avg("anomaly_ratio").alias("mean_ratio"), F.max("anomaly_ratio").alias("max_ratio"),
    )


def split_summary(metadata: DataFrame, by: list[str]) -> DataFrame:
    """Series and positive rate of each split, and the share of those whose period is known."""
    known = F.avg(F.col("period_detected").isNotNull().cast("double")).alias("period_share")
    return metadata.groupBy(*by, "split").agg(F.count("*").alias("n_series"), F.avg("y_i").alias("positive_rate"), known)


def dirty_summary(metadata: DataFrame, by: list[str], strength: str = "detect_z", fraction: str = "anomaly_fraction") -> DataFrame:
    """Least and median strength and mean fraction among anomalous series only; groups without any have nulls."""
    dirty = lambda c: F.when(F.col("y_i") == 1, F.col(c))
    held = metadata.withColumns({"_z": dirty(strength), "_f": dirty(fraction)})
    return held.groupBy(*by).agg(F.sum("y_i").alias("n_dirty"), F.min("_z").alias("least"), exact_percentile("_z", 0.5).alias("median"), F.avg("_f").alias("fraction"))


def datasets(metadata: DataFrame) -> DataFrame:
    """The distinct datasets, in order."""
    return metadata.select(dataset_of(F.col("series_id")).alias("dataset")).distinct().orderBy("dataset")


def density_percentiles(metadata: DataFrame, by: str) -> DataFrame:
    """How dense the anomalies of anomalous samples are."""
    q = metadata.filter("y_i = 1").groupBy(by).agg(exact_percentile("anomaly_ratio", 0.1, 0.5, 0.9).alias("_q"), F.max("anomaly_ratio").alias("max_density"), F.count("*").alias("n"))
    return q.select(by, "n", F.col("_q")[0].alias("p10"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p90"), "max_density")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count().orderBy(F.col("count").desc(), column)
