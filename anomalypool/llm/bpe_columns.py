"""Byte-pair encoding over a DataFrame: ids of every text, or digests of ids and of the text decoded from them."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Decoder, Encoder, as_bytes_and_decimals, load_merges
from .common import byte_list, per_batch


RECENT = 400_000  # chunks in memory, twice


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Encoder:
    """One a worker process, whatever the number of its tasks."""
    return Encoder(load_merges(vocabulary), render=as_bytes_and_decimals, memory=RECENT)


def encode_column(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>: the whole text of every row encoded. Null texts count as empty and have no ids; rows are neither merged nor lost."""

    def make():
        encoder = Encoder(load_merges(vocabulary))

        def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            ids = [encoder.ids(b.decode("utf-8", "replace")).astype(np.int32) for b in byte_list(batch.column(1))]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[id_col, "ids"])

        return step

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(per_batch(make), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def decode_column(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: ids decoded by the byte-to-text machine. Null ids give an empty text."""

    def make():
        merges = load_merges(vocabulary)

        def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            texts = [Decoder(merges).feed(ids or [], final=True) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

        return step

    rows = tokens.select(F.col(id_col), F.col(ids_col))
    return rows.mapInArrow(per_batch(make), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: each text encoded and decoded again in one pass.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded text in UTF-8. Ids leave the
    encoder part by part, and both digests and the decoder take them as they come, so that a text of any length
    needs no more than one part of it. Null texts count as empty: no tokens and the digests of nothing.
    """

    def make():
        merges, encoder = load_merges(vocabulary), _encoder(vocabulary)

        def digests(parts: Iterable[list]) -> tuple[int, str, str]:
            n, ids_sha, text_sha, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(merges)
            for part in parts:
                if not part:
                    continue
                packed, decimals = zip(*part)
                ids = np.frombuffer(b"".join(packed), dtype="<u4").tolist()
                ids_sha.update((("," if n else "") + ",".join(decimals)).encode())
                n += len(ids)
                text_sha.update(decoder.feed(ids).encode())
            text_sha.update(decoder.feed((), final=True).encode())
            return n, ids_sha.hexdigest(), text_sha.hexdigest()

        def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            gc.disable()  # nothing here refers to itself, and the collector would go through the encoder's memory again and again
            try:
                n, a, b = zip(*map(digests, encoder.many(b.decode("utf-8", "replace") for b in byte_list(batch.column(1)))))
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(per_batch(make), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
