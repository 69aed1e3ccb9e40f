"""Statistics of recordings: native aggregates and windows over (recording, pos, value, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clip

MAD_SIGMA = 1.4826  # of a normal distribution


def exact_percentile(column: str, *shares: float) -> Column:
    return F.expr(f"percentile({column}, {shares[0]})" if len(shares) == 1 else f"percentile({column}, array({', '.join(map(str, shares))}))")


def series_profile(points: DataFrame, key: str = "recording") -> DataFrame:
    """Length, label sums, mean, population deviation, median and three quantiles of each recording."""
    out = points.groupBy(key).agg(
        F.count("*").alias("length"), F.sum("label").alias("n_anomalies"), F.max("label").cast("int").alias("y_i"), F.avg("label").alias("ratio"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"), exact_percentile("value", 0.001, 0.5, 0.995, 0.999).alias("_q"),
    )
    quantiles = {n: F.col("_q")[i] for i, n in enumerate(("q001", "median", "q995", "q999"))}
    return out.withColumns(quantiles).drop("_q")


def mad_sigma(points: DataFrame, key: str = "recording") -> DataFrame:
    """Median and 1.4826 times the median distance from it."""
    medians = points.groupBy(key).agg(exact_percentile("value", 0.5).alias("median"))
    away = points.join(medians, key).withColumn("_away", F.abs(F.col("value") - F.col("median")))
    return away.groupBy(key).agg(F.first("median").alias("median"), (exact_percentile("_away", 0.5) * MAD_SIGMA).alias("mad_sigma"))


def robust_reference(points: DataFrame, clip_sigmas: float = 5.0, key: str = "recording") -> DataFrame:
    """Mean and deviation of values held within clip_sigmas robust deviations of the median; as they are where that deviation vanishes."""
    limits = mad_sigma(points, key)
    reach = clip_sigmas * F.col("mad_sigma")
    held = F.when(F.col("mad_sigma") > 1e-10, clip(F.col("value"), F.col("median") - reach, F.col("median") + reach)).otherwise(F.col("value"))
    return points.join(limits, key).groupBy(key).agg(F.avg(held).alias("ref_mean"), F.stddev_pop(held).alias("ref_std"))


def differences(points: DataFrame, key: str = "recording", lag: int = 1) -> DataFrame:
    """Points with diff, the step from lag points before; the first ones of a recording have none."""
    return points.withColumn("diff", F.col("value") - F.lag("value", lag).over(W.partitionBy(key).orderBy("pos")))


def local_scale(points: DataFrame, key: str = "recording") -> DataFrame:
    """Robust deviation of steps over sqrt 2, else the deviation of values, else 1; and the plain deviation of steps over sqrt 2, 0 below three points."""
    steps = differences(points, key)
    medians = steps.groupBy(key).agg(exact_percentile("diff", 0.5).alias("_m"), F.stddev_pop("value").alias("_std"), F.count("*").alias("_n"), F.stddev_pop("diff").alias("_sd"))
    scaled = steps.join(medians, key).groupBy(key).agg(
        (exact_percentile("abs(diff - _m)", 0.5) * MAD_SIGMA / F.sqrt(F.lit(2.0))).alias("_scale"), F.first("_std").alias("_std"), F.first("_n").alias("_n"), F.first("_sd").alias("_sd")
    )
    scale = F.when(F.col("_scale") > 1e-9, F.col("_scale")).when((F.col("_n") > 1) & (F.col("_std") > 1e-9), F.col("_std")).otherwise(1.0)
    return scaled.select(key, scale.alias("local_scale"), F.when(F.col("_n") < 3, 0.0).otherwise(F.col("_sd") / F.sqrt(F.lit(2.0))).alias("robust_sd"))


def line_fit(points: DataFrame, key: str = "recording") -> DataFrame:
    """Least-squares slope and intercept against the position."""
    x = F.col("pos").cast("double")
    return points.groupBy(key).agg(F.regr_slope(F.col("value"), x).alias("slope"), F.regr_intercept(F.col("value"), x).alias("intercept"))


def detrended(points: DataFrame, key: str = "recording") -> DataFrame:
    fit = line_fit(points, key)
    return points.join(fit, key).withColumn("value", F.col("value") - (F.col("slope") * F.col("pos") + F.col("intercept"))).drop("slope", "intercept")


def baseline_wander(points: DataFrame, horizon: int, key: str = "recording") -> DataFrame:
    """0.995 quantile of how far detrended values move in horizon steps; 0 below eight points."""
    moves = differences(detrended(points, key), key, horizon)
    return moves.groupBy(key).agg(F.when(F.count("*") < 8, 0.0).otherwise(F.coalesce(exact_percentile("abs(diff)", 0.995), F.lit(0.0))).alias("wander"))


def _extended(points: DataFrame, half: int, key: str, block: int) -> DataFrame:
    """Points with _at, the ends repeated half times beyond them, dealt to blocks of positions that overlap by half on both sides."""
    last = points.groupBy(key).agg(F.max("pos").alias("_last"))
    low = F.when(F.col("pos") == 0, F.col("pos") - half).otherwise(F.col("pos"))
    high = F.when(F.col("pos") == F.col("_last"), F.col("pos") + half).otherwise(F.col("pos"))
    held = points.join(last, key).withColumn("_at", F.explode(F.sequence(low, high))).drop("_last")
    return held.withColumn("_block", F.explode(F.sequence(F.floor((F.col("_at") - half) / block), F.floor((F.col("_at") + half) / block))))


def rolling(points: DataFrame, half: int, what: str, name: str, key: str = "recording", block: int = 4096) -> DataFrame:
    """avg or median of the half points on both sides; beyond an end its value stands again. Positions run from 0 without gaps.

    A task sees a block of a recording, not all of it.
    """
    frame = W.partitionBy(key, "_block").orderBy("_at").rowsBetween(-half, half)
    seen = _extended(points, half, key, block).withColumn(name, (F.avg("value") if what == "avg" else exact_percentile("value", 0.5)).over(frame))
    return seen.filter((F.col("_at") == F.col("pos")) & (F.col("_block") == F.floor(F.col("_at") / block))).drop("_at", "_block")


def rolling_rms(points: DataFrame, width: int, key: str = "recording") -> DataFrame:
    """Root mean square of the last width values, where there are as many."""
    frame = W.partitionBy(key).orderBy("pos").rowsBetween(1 - width, 0)
    return points.withColumns({"rms": F.sqrt(F.avg(F.col("value") * F.col("value")).over(frame)), "_n": F.count("*").over(frame)}).filter(F.col("_n") == width).drop("_n")


def visual_profile(points: DataFrame, half: int = 50, key: str = "recording") -> DataFrame:
    """sigma_vis, reach and tail_step of what is left above a rolling median."""
    rest = rolling(points, half, "median", "_baseline", key).withColumn("_rest", F.col("value") - F.col("_baseline"))
    middle = rest.groupBy(key).agg(exact_percentile("_rest", 0.5).alias("_m"), F.stddev_pop("_rest").alias("_sd"))
    size = rest.join(middle, key).withColumn("_size", F.abs(F.col("_rest") - F.col("_m")))
    q = size.groupBy(key).agg(exact_percentile("_size", 0.5, 0.995, 0.999).alias("_q"), F.first("_sd").alias("_sd"))
    sigma = F.when(F.col("_q")[0] > 1e-9, F.col("_q")[0] * MAD_SIGMA).otherwise(F.greatest("_sd", F.lit(1e-9)))
    return q.select(key, sigma.alias("sigma_vis"), F.greatest(F.col("_q")[1], sigma * 1.2).alias("reach"), F.greatest(F.col("_q")[2] - F.col("_q")[1], F.lit(0.0)).alias("tail_step"))


def autocorrelation(points: DataFrame, max_lag: int, key: str = "recording") -> DataFrame:
    """Unbiased autocorrelation at lags 1 to max_lag: each point meets the max_lag points behind it once."""
    stats = points.groupBy(key).agg(F.avg("value").alias("_mean"), F.var_pop("value").alias("_var"), F.count("*").alias("_n"))
    centred = points.join(stats, key).withColumn("_v", F.col("value") - F.col("_mean"))
    frame = W.partitionBy(key).orderBy("pos").rowsBetween(1, max_lag)
    pairs = centred.withColumn("_ahead", F.collect_list("_v").over(frame)).select(key, "_v", "_var", "_n", F.posexplode("_ahead").alias("_i", "_w"))
    sums = pairs.groupBy(key, (F.col("_i") + 1).alias("lag")).agg(F.sum(F.col("_v") * F.col("_w")).alias("_s"), F.first("_var").alias("_var"), F.first("_n").alias("_n"))
    return sums.filter("_var > 0").select(key, "lag", (F.col("_s") / F.col("_var") / (F.col("_n") - F.col("lag"))).alias("acf"))


def peaks(acf: DataFrame, threshold: float, key: str = "recording") -> DataFrame:
    """Lags higher than both neighbours and than threshold."""
    w = W.partitionBy(key).orderBy("lag")
    near = acf.withColumns({"_before": F.lag("acf").over(w), "_after": F.lead("acf").over(w)})
    return near.filter((F.col("acf") > F.col("_before")) & (F.col("acf") > F.col("_after")) & (F.col("acf") > threshold)).drop("_before", "_after")


def lag_correlation(points: DataFrame, lag: int, key: str = "recording") -> DataFrame:
    behind = points.withColumn("_behind", F.lag("value", lag).over(W.partitionBy(key).orderBy("pos")))
    return behind.groupBy(key).agg(F.corr("value", "_behind").alias("corr"))
