"""Best-fit packing of token sequences by minimum bin slack on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Encoder, load_merges, ranked
from .common import byte_list, materialise, per_batch

PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Encoder:
    """One a worker process, whatever the number of its tasks. It keeps nothing of the texts."""
    merges = load_merges(vocabulary)
    return Encoder(merges, encode_part=ranked(merges))


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths of the multiset counts that together fill room as far as any can, by a bitset of reachable sums; longer ones first."""
    seen, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, block = min(counts[length], room // length), 1
        while left > 0:
            take = min(block, left)
            steps.append((length, take, seen))
            seen |= (seen << (length * take)) & mask
            left, block = left - take, block * 2
        if seen >> room & 1:
            break
    total, chosen = seen.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def plan_bins(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Bins for a multiset of lengths up to size: (lengths in a bin, number of such bins).

    Each bin holds the longest length left and the fullest combination of the others that fits beside it, which then
    leaves the multiset. As the fullest combination stays fullest while there are enough of its lengths, it is taken
    as often as they last, so the work depends on the number of different lengths, not on the number of pieces.
    """
    left, plan = {k: v for k, v in histogram.items() if v}, []
    while left:
        longest = max(left)
        others = dict(left)
        others[longest] -= 1
        combo = [longest, *fullest({k: v for k, v in others.items() if v and k <= size - longest}, size - longest)]
        need = {k: combo.count(k) for k in set(combo)}
        times = min(left[k] // n for k, n in need.items())
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((combo, times))
    return plan


def slots(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """The plan by length: (length, first rank, ranks, per bin, first bin, offset): of the pieces of a length, numbered from 0, which go where."""
    out, used, base = [], {}, 0
    for combo, times in plan:
        at = 0
        for length in sorted(set(combo), reverse=True):
            n = combo.count(length)
            first = used.get(length, 0)
            out.append((length, first, n * times, n, base, at))
            used[length] = first + n * times
            at += n * length
        base += times
    return out


def token_pieces(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids), task, nth: the token sequence of every text, the id end_id at its end, cut where it is longer than size.

    The first piece takes what is left over, the others have size tokens. task and nth number the pieces of a length
    within the task that made them. Null texts count as empty and have the one token end_id.
    """
    extra = ", ids array<int>" if keep_ids else ""
    rows = docs.select(F.col(id_col), F.col(text_col))

    def make():
        encoder = _encoder(vocabulary)
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)

        def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            row, piece, start, length, crc, nth, kept = [], [], [], [], [], [], []
            texts = (raw for i in range(0, batch.num_rows, 256) for raw in byte_list(batch.column(1).slice(i, 256)))
            for at, raw in enumerate(texts):
                ids = np.append(encoder.ids(raw.decode("utf-8", "replace")), np.uint32(end_id)).astype("<u4")
                head = len(ids) % size or size
                cuts = [0, *range(head, len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(at), piece.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    nth.append(seen[b - a])
                    seen[b - a] += 1
                    if keep_ids:
                        kept.append(ids[a:b].astype(np.int32))
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            arrays += [pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []
            names = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "task", "nth"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([task] * len(row), pa.int32()), pa.array(nth, pa.int64())], names=names)

        return step

    return rows.mapInArrow(per_batch(make), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {PIECES}{extra}, task int, nth bigint")


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32, (ids,) sequence_id, offset: every piece of token_pieces() at its place in sequences of at most size tokens.

    The pieces are written once. Only the histogram of lengths, size numbers at most, comes to the driver, which
    plans the bins from it; the plan goes back as ranges of ranks. A piece's rank among those of its length is its
    number within its task plus the pieces of that length in earlier tasks. Pieces of full size need no plan.
    Sequences are gapless from offset 0. Repeated and null ids are packed like others; no rows give no sequences.
    """
    spark: SparkSession = docs.sparkSession
    pieces = materialise(token_pieces(docs, vocabulary, size, end_id, id_col, text_col, keep_ids), "pack-pieces")
    part = pieces.filter(F.col("length") < size)
    by_task = part.groupBy("task", "length").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in part.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = slots(plan_bins(histogram, size))
    plan = F.broadcast(spark.createDataFrame(where or [(-1, 0, 0, 1, 0, 0)], "_l long, _first long, _ranks long, _per long, _base long, _at long"))

    before = F.sum("_n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    offsets = by_task.select(F.col("task").alias("_task"), F.col("length").alias("_length"), F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = part.join(offsets, (part["task"] == F.col("_task")) & (part["length"] == F.col("_length"))).withColumn("_rank", F.col("nth") + F.col("_before"))
    nth = F.col("_rank") - F.col("_first")
    placed = ranked.join(plan, (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("_first")) & (nth < F.col("_ranks")))
    columns = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    shared = placed.select(*columns, (F.col("_base") + F.floor(nth / F.col("_per"))).cast("long").alias("sequence_id"), (F.col("_at") + nth % F.col("_per") * F.col("length")).cast("long").alias("offset"))
    alone = pieces.filter(F.col("length") == size)
    # the full ones have negative numbers: the task in the high bits, the place in the task in the low ones
    own = (-(F.col("task").cast("long") * F.lit(1 << 40) + F.col("nth")) - 1).alias("sequence_id")
    return shared.unionByName(alone.select(*columns, own, F.lit(0).cast("long").alias("offset")))
