"""Positions in recordings, counted without gathering a recording in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written


def with_positions(df: DataFrame, key: str, order: list[Column], name: str = "pos") -> DataFrame:
    """df with the position of each row among those of its key, from 0, in the given order.

    Rows are dealt by ranges of (key, order), so that a key with most of the rows is spread; a row's position is its
    place in its task plus the rows of its key in earlier tasks, of which there is one number for a task and key.
    """
    placed = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    placed = written(placed.withColumns({"_place": F.monotonically_increasing_id(), "_task": F.spark_partition_id()}), "positions")
    tasks = placed.groupBy(key, "_task").agg(F.min("_place").alias("_least"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(key).orderBy("_task").rowsBetween(W.unboundedPreceding, -1))
    starts = tasks.select(F.col(key).alias("_k"), F.col("_task").alias("_t"), "_least", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = placed.join(starts, placed[key].eqNullSafe(F.col("_k")) & (F.col("_task") == F.col("_t")))
    return joined.withColumn(name, F.col("_place") - F.col("_least") + F.col("_before")).select(*df.columns, name)


class Growing:
    """An array that grows by an eighth, so that a long one is never there twice."""

    def __init__(self) -> None:
        self.held, self.n = np.empty(0), 0

    def add(self, part: np.ndarray) -> None:
        if not self.n or part.dtype != self.held.dtype:
            self.held = self.held[: self.n].astype(np.result_type(self.held, part) if self.n else part.dtype)
        if (n := self.n + len(part)) > len(self.held):
            self.held.resize(n + n // 8, refcheck=False)
        self.held[self.n : n] = part
        self.n = n

    def all(self) -> np.ndarray:
        return self.held[: self.n]


def _run(batch: pa.RecordBatch, key: tuple, at: int) -> int:
    """Where the rows with this key end that begin at a row of a batch in order of its keys."""
    end = batch.num_rows
    for column, value in zip(batch.columns, key):
        rest = column.slice(at, end - at)
        same = pc.is_null(rest) if value is None else pc.fill_null(pc.equal(rest, value), False)
        end = at + (pc.index(same, False).as_py() if not same[-1].as_py() else len(same))
    return end


def by_key(df: DataFrame, keys: list[str], order: list[str], columns: list[str], kernel: Callable[..., Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """What kernel(key, *arrays of columns, in order) yields for the rows of each key.

    Spark sorts, and rows come in batches of bounded size: of a key there is one array a column, and nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                key = tuple(batch.column(i)[at].as_py() for i in range(len(keys)))
                end = _run(batch, key, at)
                if held and key != last:
                    arrays, held = [x.all() for x in held], []
                    yield from kernel(last, *arrays)
                    del arrays
                last, held = key, held or [Growing() for _ in columns]
                for x, column in zip(held, batch.columns[len(keys) :]):
                    x.add(column.slice(at, end - at).to_numpy(zero_copy_only=False))
                at = end
        if held:
            arrays, held = [x.all() for x in held], []
            yield from kernel(last, *arrays)

    # by a hash, as a join by these keys just before could stand for repartition() by them, and might deal a key to several tasks
    dealt = df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)
    return dealt.select(*keys, *columns).mapInArrow(run, schema)
