"""Samples from recordings: a grid that the labels don't move, a budget of anomalies and a screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SamplerConfig
from ..functions.scalars import clip, notes, up_to_multiple
from .profile import robust_reference


def chunk_size(period: Column, config: SamplerConfig) -> Column:
    """The base size, or as many whole periods as that takes and periods_per_chunk at least, within the bounds."""
    own = up_to_multiple(F.greatest(F.lit(config.base_chunk), period * config.periods_per_chunk), period)
    size = F.when(period >= config.period_range[0], own).otherwise(F.lit(config.base_chunk))
    if config.legacy:
        size = F.least(size, F.greatest(F.lit(config.legacy_chunk_max), F.coalesce(period, F.lit(0))))
    return clip(size, config.min_length, config.max_length).cast("long")


def chunk_grid(points: DataFrame, config: SamplerConfig, periods: DataFrame | None = None, key: str = "recording") -> DataFrame:
    """One row per slot: recording, sample (full or chunk{N}), start, length, sums of labels and value statistics, period.

    Recordings up to split_threshold are one slot. Slots shorter than min_length are not here; others keep their
    number whatever becomes of their neighbours.
    """
    facts = points.groupBy(key).agg(F.count("*").alias("original_length"))
    facts = facts.join(periods, key, "left") if periods is not None else facts.withColumn("period", F.lit(None).cast("int"))
    facts = facts.withColumn("_size", F.when(F.col("original_length") <= config.split_threshold, F.col("original_length")).otherwise(chunk_size(F.col("period"), config)))
    slotted = points.join(facts, key).withColumn("slot", F.floor(F.col("pos") / F.col("_size")))
    slots = slotted.groupBy(key, "slot", F.col("_size").alias("slot_size"), "original_length", "period").agg(
        F.min("pos").alias("start"), F.count("*").alias("length"), F.sum("label").cast("long").alias("num_point_anomalies"), F.max("label").cast("int").alias("y_i"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
    )
    whole = F.col("original_length") <= config.split_threshold
    return slots.filter((F.col("length") >= config.min_length) & (F.col("length") <= config.max_length)).withColumns({
        "is_split": ~whole, "sample": F.when(whole, "full").otherwise(F.concat(F.lit("chunk"), F.col("slot").cast("string"))), "anomaly_ratio": F.col("num_point_anomalies") / F.col("length"),
    })


def judged(slots: DataFrame, reference: DataFrame, config: SamplerConfig, key: str = "recording") -> DataFrame:
    """Slots with reject_reason: null, representativeness (clean slots only, tried first) or budget."""
    tolerance = config.legacy_tolerance if config.legacy else config.stats_tolerance
    band = tolerance * F.greatest("ref_std", F.lit(1e-10))
    alike = (F.abs(F.col("mean") - F.col("ref_mean")) <= band) & (F.abs(F.col("std") - F.col("ref_std")) <= band)
    reason = F.when((F.col("y_i") == 0) & ~alike, "representativeness").when(F.col("anomaly_ratio") > config.max_anomaly_ratio, "budget")
    return slots.join(reference, key).withColumn("reject_reason", reason)


def samples(points: DataFrame, config: SamplerConfig, group: str, dataset: Column, periods: DataFrame | None = None, key: str = "recording") -> DataFrame:
    """The samples that stay, with their metadata and where they are in their recording."""
    slots = judged(chunk_grid(points, config, periods, key), robust_reference(points, config.reference_clip, key), config, key).filter("reject_reason IS NULL")
    named = slots.withColumn("dataset", dataset)
    series_id = F.concat_ws("_", F.concat_ws("__", F.lit(group), F.col("dataset"), F.col(key)), F.col("sample"))
    said = notes(F.when(F.col("period").isNotNull(), F.concat(F.lit("period="), F.col("period").cast("string"))))
    return named.select(
        "dataset", key, series_id.alias("series_id"), "length", "num_point_anomalies", "y_i", "is_split", "original_length", said.alias("source_notes"), F.col("period").alias("period_detected"),
        F.lit(True).alias("is_representative"), "anomaly_ratio", "start", "slot", "slot_size",
    )


def sample_points(points: DataFrame, kept: DataFrame, key: str = "recording") -> DataFrame:
    """The points of samples in the form of a pool: series_id, time_index, value, label."""
    sizes = kept.select(F.col(key).alias("_k"), F.col("slot_size").alias("_size")).distinct()
    slotted = points.join(sizes, F.col(key) == F.col("_k")).withColumn("_slot", F.floor(F.col("pos") / F.col("_size")))
    spans = kept.select(F.col(key).alias("_r"), F.col("slot").alias("_s"), "series_id", F.col("start").alias("_start"))
    inside = slotted.join(spans, (F.col(key) == F.col("_r")) & (F.col("_slot") == F.col("_s")))
    return inside.select("series_id", (F.col("pos") - F.col("_start")).cast("long").alias("time_index"), F.col("value").cast("double"), F.col("label").cast("tinyint"))
