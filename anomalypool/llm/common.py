"""What the operators of this subpackage share: scratch tables, Arrow access to texts, counted joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import forget, written as materialise  # noqa: F401  what the operators write in between

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def byte_list(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each string; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: make() runs once a task, what it returns once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return run


def append_columns(df: DataFrame, text: str, names: list[str], kinds: list[T.DataType], compute: Callable[[list[bytes]], list[pa.Array]]) -> DataFrame:
    """df with more columns that compute() derives from the bytes of one text column; the others pass through Arrow untouched."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    at = df.columns.index(text)

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([*batch.columns, *compute(byte_list(batch.column(at)))], names=[f.name for f in schema.fields])

    return df.mapInArrow(per_batch(lambda: step), schema)


def skew_safe_lookup(rows: DataFrame, key: str, facts: DataFrame, fact_key: str, weight: str, hot_groups: int = 1024) -> DataFrame:
    """rows left-joined with facts, one fact a key, where one key may hold a third of the rows.

    The hot_groups heaviest keys (weight: a count in facts) are broadcast: that many rows at most, whatever the
    input. Every other key holds less than a 1 / hot_groups share of the rows and goes through the shuffle; rows
    already served get a key of their own there, so that they spread.
    """
    others = [c for c in facts.columns if c != fact_key]
    heavy = facts.orderBy(F.col(weight).desc(), F.col(fact_key)).limit(hot_groups)
    hot = F.broadcast(heavy.select(F.col(fact_key).alias("_hk"), F.struct(*others).alias("_hot")))
    served = rows.join(hot, rows[key] == F.col("_hk"), "left")
    spread = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("~"), F.monotonically_increasing_id().cast("string")))
    cold = facts.select(F.col(fact_key).alias("_ck"), F.struct(*others).alias("_cold"))
    joined = served.withColumn("_jk", spread).join(cold, F.col("_jk") == F.col("_ck"), "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*rows.columns, *(found[c].alias(c) for c in others))


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """df without the rows whose key is in the one column of gone; rows with a null key stay."""
    name = free_name(df, "_gone")
    keys = gone.toDF(name).filter(F.col(name).isNotNull()).distinct()
    return df.join(keys, df[key] == keys[name], "left_anti")
