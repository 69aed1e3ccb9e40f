"""Picking series from a pool and describing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dataset_of, stable_rank


def pick(metadata: DataFrame, *, anomalous: bool | None = None, anomaly_type: str | None = None, base_type: str | None = None, dataset: str | None = None, split: str | None = None, min_ratio: float | None = None, max_ratio: float | None = None, sort_by: str | None = None, seed: int | None = None, n: int | None = None) -> DataFrame:
    """Rows of metadata that meet all conditions given; bounds count as within. sort_by (falling) goes before seed (by hash); ties by id."""
    ratio = F.col("anomaly_ratio" if "anomaly_ratio" in metadata.columns else "anomaly_fraction")
    tests = [
        None if anomalous is None else F.col("y_i") == int(anomalous), None if anomaly_type is None else F.col("anomaly_type") == anomaly_type, None if base_type is None else F.col("base_type") == base_type,
        None if dataset is None else dataset_of(F.col("series_id")) == dataset, None if split is None else F.col("split") == split, None if min_ratio is None else ratio >= min_ratio, None if max_ratio is None else ratio <= max_ratio,
    ]
    for test in tests:
        metadata = metadata if test is None else metadata.filter(test)
    if sort_by is not None:
        metadata = metadata.orderBy(F.col(sort_by).desc(), "series_id")
    elif seed is not None:
        metadata = metadata.orderBy(stable_rank(seed, F.col("series_id")), "series_id")
    return metadata if n is None else metadata.limit(n)


def points_of(points: DataFrame, ids: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Points of the picked series, of positions [start, end) if given."""
    if start is not None:
        points = points.filter(F.col("time_index") >= start)
    if end is not None:
        points = points.filter(F.col("time_index") < end)
    return points.join(ids.select("series_id"), "series_id", "left_semi")


def described(points: DataFrame, metadata: DataFrame) -> DataFrame:
    """Points with their series' metadata; those of a series without any keep nulls."""
    return points.join(metadata.drop(*[c for c in metadata.columns if c != "series_id" and c in points.columns]), "series_id", "left")


def head(metadata: DataFrame, n: int, order: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """The first n rows in a stated order, as files have none."""
    return metadata.orderBy(*order).limit(n)


def tags(metadata: DataFrame, columns: tuple[str, ...] = ("base_type", "anomaly_type", "source_notes", "split")) -> DataFrame:
    """series_id and a JSON object of those of the columns that are there and not null."""
    here = [c for c in columns if c in metadata.columns]
    return metadata.select("series_id", F.to_json(F.struct(*here)).alias("tags") if here else F.lit("{}").alias("tags"))
