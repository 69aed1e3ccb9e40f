"""A synthetic pool, validated and split."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PoolConfig
from ..functions.scalars import hash_side
from ..kernels.generate import generate_series
from ..operators import validate
from ..sources.pools import write_document, write_pool
from ..sources.scratch import written

_META = "series_id string, length bigint, num_point_anomalies bigint, y_i int, is_split boolean, original_length bigint, source_notes string, base_type string, base_params string, anomaly_type string, severity double, num_segments int, segments string, severity_effective double, detect_z double, anomaly_fraction double, target_fraction double"


def series(spark: SparkSession, config: PoolConfig, partitions: int | None = None) -> DataFrame:
    """One row a series: metadata, values and labels. A series depends on its number, not on the others or on how they are dealt."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids in (batch["id"][a : a + 64] for a in range(0, len(batch), 64)):
                rows = []
                for i in ids:
                    x, y, meta = generate_series(int(i), config)
                    rows.append({**meta, "values": x, "labels": y.astype(int)})
                yield pd.DataFrame(rows)

    ids = spark.range(0, config.num_series, 1, partitions) if partitions else spark.range(config.num_series)
    return ids.mapInPandas(make, f"{_META}, values array<double>, labels array<tinyint>")


def build(spark: SparkSession, config: PoolConfig) -> tuple[DataFrame, DataFrame]:
    """Points and metadata, with the side of each series by the hash of its id."""
    made = written(series(spark, config), "synthetic")
    points = made.select("series_id", F.posexplode(F.arrays_zip("values", "labels")).alias("time_index", "_p")).select("series_id", F.col("time_index").cast("long"), F.col("_p.values").alias("value"), F.col("_p.labels").alias("label"))
    return points, made.drop("values", "labels").withColumn("split", hash_side(config.dev_fraction, config.seed, "split", F.col("series_id")))


def publish(points: DataFrame, metadata: DataFrame, config: PoolConfig, root: str) -> None:
    validate.validate(points, metadata)
    write_pool(points, metadata, root, config.group)
    totals = metadata.agg(F.sum("length").alias("num_rows"), F.sum("y_i").alias("anomalous_series"), F.avg("anomaly_fraction").alias("mean_anomaly_fraction")).first().asDict()
    write_document(points.sparkSession, {**asdict(config), **totals}, f"{root}/{config.group}_manifest.json")
