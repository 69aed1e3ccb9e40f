"""The cheap scan of all series, the budget of deep looks, and the ranked list."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import stable_rank
from .profile import exact_percentile


def cheap_scan(points: DataFrame, key: str = "series_id") -> DataFrame:
    """cheap_score of each series: how many robust deviations its farthest value is from its median; 0 where it has no spread."""
    q = points.groupBy(key).agg(exact_percentile("value", 0.25, 0.5, 0.75).alias("_q"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.max("label").cast("int").alias("y_i"))
    spread = (F.col("_q")[2] - F.col("_q")[0]) / 1.349
    far = F.greatest(F.col("_hi") - F.col("_q")[1], F.col("_q")[1] - F.col("_lo"))
    return q.select(key, F.when(spread > 1e-12, far / spread).otherwise(0.0).alias("cheap_score"), "y_i")


def allowed(n_series: int, budget: int) -> int:
    """Deep looks for n_series at budget per thousand."""
    return math.floor(budget * n_series / 1000)


def budget_topk(scored: DataFrame, budget: int, key: str = "series_id", score: str = "cheap_score") -> DataFrame:
    """The series that a budget lets a deep look at, best score first; ties by id."""
    return scored.orderBy(F.col(score).desc(), key).limit(allowed(scored.count(), budget))


def random_baseline(scored: DataFrame, budget: int, seed: int = 42, key: str = "series_id") -> DataFrame:
    """As many by hash, for comparison."""
    return scored.orderBy(stable_rank(seed, "random", F.col(key)), key).limit(allowed(scored.count(), budget))


def ranked_list(scored: DataFrame, deviations: float = 2.0, key: str = "series_id", score: str = "final_score") -> DataFrame:
    """series by final score with is_reported: above mean plus so many deviations of all scores. Ranks number the whole list."""
    from pyspark.sql import Window as W

    limit = scored.agg((F.avg(score) + deviations * F.stddev_pop(score)).alias("_limit"))
    rank = F.row_number().over(W.orderBy(F.col(score).desc(), key))
    return scored.join(F.broadcast(limit)).select(key, score, rank.alias("rank"), (F.col(score) > F.col("_limit")).alias("is_reported"))  # one row of limit
