"""Raw recordings: a folder of datasets, each a folder of CSV or Parquet files, whose rows are in order of time."""

from __future__ import annotations

import io
import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
RAW = "dataset string, recording string, pos bigint, value double, label tinyint"


def _read(name: str, content: bytes) -> pd.DataFrame | None:
    """value and label of a file, coerced; None if it can't be read or lacks one of them."""
    try:
        cells = pd.read_parquet(io.BytesIO(content)) if name.endswith(".parquet") else pd.read_csv(io.BytesIO(content))
    except Exception as e:  # one bad file must not end the others
        log.error("%s can't be read: %s", name, e)
        return None
    cells.columns = [str(c).strip().lower() for c in cells.columns]
    if "value" not in cells and "data" in cells:
        cells = cells.rename(columns={"data": "value"})
    if not {"value", "label"} <= set(cells.columns):
        log.warning("%s has no value or no label", name)
        return None
    value = pd.to_numeric(cells["value"], errors="coerce").ffill()
    label = (pd.to_numeric(cells["label"], errors="coerce").fillna(0) > 0).astype(np.int8)
    keep = value.notna()
    return pd.DataFrame({"value": value[keep].astype(float), "label": label[keep]}).reset_index(drop=True)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            dataset, name = path.rstrip("/").split("/")[-2:]
            found = _read(name, content)
            if found is not None and len(found):
                yield pd.DataFrame({"dataset": dataset, "recording": name.rsplit(".", 1)[0], "pos": np.arange(len(found)), "value": found["value"], "label": found["label"]})


def raw_points(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, recording, pos, value, label) of all files dataset/recording.{csv,parquet} in a folder.

    A file is read whole in one task, as the order of its rows is its time. Column names may be in any case and
    padded, `data` stands for `value`. Cells that are no number take the value before them; rows before the first
    number, files without one, unreadable files and files without both columns are left out. A missing folder gives
    no rows.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        log.error("%s does not exist", folder)
        return spark.createDataFrame([], RAW)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(F.lower("path").rlike(r"\.(csv|parquet)$"))
    return files.select("path", "content").mapInPandas(_parse, RAW)


def view(points: DataFrame, recording: str, start: int, end: int) -> DataFrame:
    """Positions [start, end) of one recording, in order."""
    return points.filter((F.col("recording") == recording) & F.col("pos").between(start, end - 1)).orderBy("pos")
