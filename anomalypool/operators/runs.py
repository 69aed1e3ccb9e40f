"""Runs of points: clusters of anomalies, clean and flat stretches, dilution, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _islands(rows: DataFrame, key: str, gap: int, name: str) -> DataFrame:
    """Number the runs of rows whose positions are at most gap apart."""
    w = W.partitionBy(key).orderBy("pos")
    new = F.when(F.col("pos") - F.lag("pos").over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(w)).drop("_new")


def _spans(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key, name).agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count("*").alias("n_points"))


def anomaly_clusters(points: DataFrame, lookahead: int = 100, key: str = "recording") -> DataFrame:
    """Spans of anomalous points with at most lookahead positions from one to the next."""
    return _spans(_islands(points.filter("label = 1"), key, lookahead, "cluster"), key, "cluster")


def clean_runs(points: DataFrame, min_length: int, max_length: int, key: str = "recording") -> DataFrame:
    """Stretches without anomalies, cut after max_length, of min_length at least."""
    runs = _islands(points.filter("label = 0"), key, 1, "run")
    first = F.min("pos").over(W.partitionBy(key, "run"))
    cut = runs.withColumn("piece", F.floor((F.col("pos") - first) / max_length))
    return cut.groupBy(key, "run", "piece").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count("*").alias("n_points")).filter(F.col("n_points") >= min_length)


def flat_runs(points: DataFrame, min_length: int = 2, key: str = "recording") -> DataFrame:
    """Stretches of equal values."""
    w = W.partitionBy(key).orderBy("pos")
    new = F.when(F.col("value") == F.lag("value").over(w), 0).otherwise(1)
    runs = points.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return _spans(runs, key, "run").filter(F.col("n_points") >= min_length)


def dilution_point(points: DataFrame, after: int, target: float, acceptable: float, key: str = "recording") -> DataFrame:
    """Least length beyond `after` at which the share of anomalies from the start is at most target, else at most acceptable, else `after`."""
    so_far = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    ratio = points.select(key, (F.col("pos") + 1).alias("k"), (F.sum("label").over(so_far) / (F.col("pos") + 1)).alias("r"))
    best = ratio.groupBy(key).agg(F.min(F.when((F.col("k") > after) & (F.col("r") <= target), F.col("k"))).alias("_t"), F.min(F.when((F.col("k") > after) & (F.col("r") <= acceptable), F.col("k"))).alias("_a"))
    return best.select(key, F.coalesce("_t", "_a", F.lit(after)).cast("long").alias("end"))


def segment_labels(points: DataFrame, segments: DataFrame, key: str = "recording", width: int = 1024) -> DataFrame:
    """Points with in_segment: whether a segment [start, end) of their recording holds them. Both sides meet on blocks of width positions."""
    blocks = segments.withColumn("_block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    blocks = blocks.select(F.col(key).alias("_k"), "_block", F.col("start").alias("_s"), F.col("end").alias("_e"))
    at = points.withColumn("_b", F.floor(F.col("pos") / width))
    hit = at.join(blocks, (at[key] == F.col("_k")) & (F.col("_b") == F.col("_block")) & (F.col("pos") >= F.col("_s")) & (F.col("pos") < F.col("_e")), "left_semi").select(key, "pos").distinct()
    return points.join(hit.withColumn("_in", F.lit(1)), [key, "pos"], "left").withColumn("in_segment", F.coalesce("_in", F.lit(0))).drop("_in")


def crowded_segments(segments: DataFrame, margin: int = 25, key: str = "recording") -> DataFrame:
    """Segments that begin less than margin after an earlier one of their recording ends."""
    earlier = W.partitionBy(key).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    return segments.withColumn("_last", F.max("end").over(earlier)).filter(F.col("start") < F.col("_last") + margin).drop("_last")
