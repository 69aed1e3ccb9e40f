"""From raw recordings to a composed, split and validated pool."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..config import SamplerConfig
from ..functions.scalars import is_whole, machine_of, round_binary
from ..kernels.legacy import Cutter
from ..kernels.signal import detect_period
from ..operators import chunks, compose, validate
from ..operators.order import by_key
from ..sources.pools import write_document, write_pool
from ..sources.scratch import written

_LEGACY = "dataset string, recording string, sample string, start bigint, length bigint, num_point_anomalies bigint, y_i int, is_split boolean, original_length bigint, source_notes string, period_detected int, is_representative boolean, anomaly_ratio double, positions array<bigint>"
POSITIONS = 1 << 19  # of samples that leave a task at once


def periods(points: DataFrame, config: SamplerConfig, key: str = "recording") -> DataFrame:
    """(recording, period): the detector sees one recording at a time, in order; short ones have none."""

    def one(own: tuple, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = detect_period(x, config, overwrite=True) if len(x) >= config.min_length_for_period else None
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([found], pa.int32())], names=[key, "period"])

    return by_key(points, [key], ["pos"], ["value"], one, f"{key} string, period int")


def legacy_samples(points: DataFrame, config: SamplerConfig) -> DataFrame:
    """Samples the older way, with the positions of their points."""
    kinds = to_arrow_schema(_parse_datatype_string(_LEGACY))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)

    def one(own: tuple, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = detect_period(x, config) if len(x) >= config.min_length_for_period else None
        rows, held = [], 0
        for cut in Cutter(x, y, found, config).cuts():
            at = cut.positions()
            n, marked = len(at), int(y[at].sum())
            said = ";".join([*([f"period={found}"] if found else []), *cut.notes])
            rows.append((*own, cut.name, cut.start, n, marked, int(marked > 0), cut.split, len(x), said, found, True, marked / n, at))
            held += n
            if held >= POSITIONS:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)

    return by_key(points, ["dataset", "recording"], ["pos"], ["value", "label"], one, _LEGACY)


def build(points: DataFrame, group: str, config: SamplerConfig = SamplerConfig(), find_periods: bool = True) -> dict:
    """points, metadata, full_points, full_metadata and stats of a pool from raw points (dataset, recording, pos, value, label).

    Points are only joined to the samples that stay; composition and split see one row a sample.
    """
    keyed = written(points.withColumn("_own", F.concat_ws("/", "dataset", "recording")), "raw-points")
    if config.legacy:
        found = written(legacy_samples(keyed.drop("_own"), config), "legacy-samples")
        found = found.withColumn("series_id", F.concat_ws("_", F.concat_ws("__", F.lit(group), "dataset", "recording"), "sample"))
        at = found.select("dataset", "recording", "series_id", F.posexplode("positions").alias("time_index", "pos"))
        pool = at.join(keyed, ["dataset", "recording", "pos"]).select("series_id", F.col("time_index").cast("long"), "value", F.col("label").cast("tinyint"))
        found = found.drop("positions", "sample")
    else:
        known = periods(keyed, config, "_own") if find_periods else None
        found = chunks.samples(keyed, config, group, F.split("_own", "/")[0], known, "_own")
        found = found.withColumn("series_id", F.regexp_replace("series_id", f"^{group}__(.*?)__.*?/", f"{group}__$1__")).withColumn("recording", F.split("_own", "/")[1])
        found = written(found, "samples")
        pool = chunks.sample_points(keyed, found, "_own")
    found = found.withColumn("machine", machine_of(F.col("recording")))
    kept, stats = compose.compose(found, config, ["dataset", "recording"])
    kept = written(kept, "composed")
    if not config.legacy:
        sides = written(compose.split_machines(compose.machine_counts(kept), group, config.dev_fraction, config.seed), "sides")
        kept, found = (compose.with_split(x, sides, group, config) for x in (kept, found))
        if (apart := compose.straddling(kept).limit(5).collect()):
            raise validate.PoolError(f"machines on both sides: {apart}")
    order = ["dataset", "recording", "start"]
    columns = ["series_id", "length", "num_point_anomalies", "y_i", "is_split", "original_length", "source_notes", *([] if config.legacy else ["split"]), "period_detected", "is_representative", round_binary(F.col("anomaly_ratio"), 4).alias("anomaly_ratio")]
    return {"points": pool.join(kept.select("series_id"), "series_id", "left_semi"), "metadata": kept.orderBy(*order).select(*columns), "full_points": pool, "full_metadata": found.orderBy(*order).select(*columns), "stats": stats}


def publish(pool: dict, root: str, group: str, config: SamplerConfig = SamplerConfig(), full: bool = True) -> None:
    """Validate, then write: nothing is written of a pool that violates anything."""
    ratio = config.max_anomaly_ratio
    if config.legacy:
        ratio = F.when(is_whole(F.col("source_notes")), config.legacy_max_ratio).otherwise(config.legacy_acceptable_ratio)
    validate.validate(pool["points"], pool["metadata"], lengths=(config.min_length, config.max_length), max_ratio=ratio)
    write_pool(pool["points"], pool["metadata"], root, group)
    if full:
        write_pool(pool["full_points"], pool["full_metadata"], root, group, full=True)
    totals = pool["metadata"].agg(F.count("*").alias("final_samples"), F.avg("y_i").alias("final_positive_rate")).first().asDict()
    whole = pool["full_metadata"].agg(F.count("*").alias("full_samples"), F.avg("y_i").alias("full_positive_rate")).first().asDict()
    settings = {k: getattr(config, k) for k in ("max_anomaly_ratio", "positive_rate", "recording_share", "samples_per_recording", "seed", "dev_fraction")}
    write_document(pool["points"].sparkSession, {"group": group, **settings, **pool["stats"], **whole, **totals}, f"{root}/{group}_manifest.json")
