"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def root(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it; where that is unset a temporary one, in local mode only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share: intermediate tables are written there")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="anomalypool-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(spark: SparkSession, label: str) -> str:
    """A new folder within the shared one, for files that go when the driver's JVM ends."""
    path = f"{root(spark)}/{label}-{uuid.uuid4().hex}"
    where, files = _place(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df written once into the shared folder and read back, so that lineage ends here: what follows neither recomputes it nor depends on how it was dealt.

    The files go with forget(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.mode("overwrite").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete what written() wrote. Nothing may be read from these tables any more, nor from what was derived from them."""
    for t in tables:
        where, files = _place(t.sparkSession, t._scratch_path)
        files.delete(where, True)
