"""Removal of repeated long strings across documents, by bytes.

A string of LENGTH bytes is found again through an anchor: the GRAM-byte windows in it of least hash, which depend on
that string alone, so that all its copies have the same. All texts are sampled at these anchors, about one in 28
bytes. Anchors meet by hash together with two independent hashes of their surroundings, which hold all strings of LENGTH
bytes around them. Copies of the same surroundings, equal in all 128 bits of these, are gathered before anything is
compared: all but the first are covered whole. What is left are the first occurrences of different surroundings of the
same anchor: their bytes are fetched and compared through a Burrows-Wheeler transform (bwt.py), block by block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import earlier_elsewhere
from .common import byte_list, materialise, per_batch

LENGTH, GRAM = 100, 48
BUCKET_BYTES = 16 << 20  # text whose anchors share a bucket
LEAST_BUCKETS = 256
BLOCK = 1 << 19  # bytes of surroundings that are sorted at once
SAMPLE, HOT = 64, 1024  # of the texts, to find the most frequent anchors; how many of these are dealt out string by string
HOT_SHARE = 1 / 256  # of the sampled texts that an anchor must be in to count as frequent
SETTLE_BYTES = 8 << 20  # texts whose entries are sorted at once before they travel
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_ROW = np.dtype([("h", "<u8"), ("c", "<u8"), ("e", "<u8"), ("doc", "<i8"), ("lo", "<i4"), ("n", "<i4")])


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up = np.full(n, base, dtype=np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_VALUES = np.random.default_rng(7).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


class Rolling:
    """One of two independent polynomial hashes of any string of a text."""

    def __init__(self, raw: np.ndarray, which: int) -> None:
        up, self.down = _powers(_BASES[which], 1 << max(16, (len(raw) + 1).bit_length()))
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_VALUES[which][raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * self.down[start])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each anchor, mixed anew: anchors are least hashes, so their own leading bits are nearly all zero."""
    return (_mix(h * np.uint64(_BASES[0]) + np.uint64(1)) >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """least (or greatest) of every width neighbours."""
    span = 1
    while span * 2 <= width:
        x = least(x[:-span], x[span:])
        span *= 2
    return least(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class Anchors:
    """Anchors and rolling hashes of one text."""

    def __init__(self, raw: bytes, length: int, gram: int) -> None:
        n = len(raw)
        self.raw, self.n, self.length, self.gram = np.frombuffer(raw, dtype=np.uint8), n, length, gram
        self.first = Rolling(self.raw, 0)
        grams = self.first.of(np.arange(n - gram + 1), gram)
        width = length - gram + 1
        least = _slide(grams, width, np.minimum)
        edge = np.zeros(width - 1, dtype=np.uint64)
        self.at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == grams)
        self.grams = grams[self.at]

    def rows(self, doc: int, hot: np.ndarray) -> np.ndarray:
        """An entry for each anchor and its surroundings; for frequent anchors one for each string around it instead."""
        second = Rolling(self.raw, 1)
        lo = np.maximum(self.at - (self.length - self.gram), 0)
        size = np.minimum(self.at + self.length, self.n) - lo
        frequent = np.isin(self.grams, hot) if len(hot) else np.zeros(len(self.at), dtype=bool)

        def entries(start: np.ndarray, n: np.ndarray | int, h: np.ndarray | None) -> np.ndarray:
            out = np.empty(len(start), dtype=_ROW)
            out["c"], out["e"] = self.first.of(start, n) + np.asarray(n, dtype=np.uint64), second.of(start, n)
            out["h"], out["doc"], out["lo"], out["n"] = out["e"] ^ _mix(out["c"]) if h is None else h, doc, start, n
            return out

        made = entries(lo[~frequent], size[~frequent], self.grams[~frequent])
        if not frequent.any():
            return made
        strings = np.unique(np.concatenate([np.arange(a, a + n - self.length + 1) for a, n in zip(lo[frequent], size[frequent])]))
        return np.concatenate([made, entries(strings, self.length, None)])


def _settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows in order of anchor and surroundings; which of them are first of their kind, and which are covered by such a first."""
    rows = rows[np.lexsort((rows["lo"], rows["doc"], rows["e"], rows["c"], rows["h"]))]
    first = np.ones(len(rows), dtype=bool)
    for key in ("h", "c", "e"):
        same = rows[key][1:] == rows[key][:-1]
        first[1:] = ~same if key == "h" else first[1:] | ~same
    lead = rows[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(rows) else rows
    covered = ~first & ((rows["doc"] != lead["doc"]) | (rows["lo"] != lead["lo"]))
    return rows, first, covered


def _spans(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """doc and span (its start in the high 32 bits, its end in the low), those that meet in a document as one."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order].astype(np.int64), lo[order].astype(np.int64) + n[order]
    if not len(doc):
        return doc, lo
    begin = np.concatenate([[True], doc[1:] != doc[:-1]])
    base = np.cumsum(begin).astype(np.int64) << 40  # so that ends don't reach into the next document
    top = np.maximum.accumulate(hi + base)
    fresh = begin.copy()
    fresh[1:] |= lo[1:] + base[1:] > top[:-1]
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], lo[at] << 32 | (top[last] - base[last])


_FOUND = "_doc bigint, _ask boolean, _span bigint"


def _found(doc: np.ndarray, span: np.ndarray, ask: bool) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(doc), 100_000):
        part = slice(a, a + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(doc[part]), pa.array([ask] * len(doc[part]), pa.bool_()), pa.array(span[part])], names=["_doc", "_ask", "_span"])


def _anchor_rows(docs: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """_bucket, _rows: all entries by bucket, packed. Of equal entries of a batch only the first travels; the others, in buckets below 0, are covered."""
    def pack(rows: np.ndarray) -> bytes:
        return b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in _ROW.names)

    def settled(made: list[np.ndarray]) -> pa.RecordBatch:
        rows, first, covered = _settle(np.concatenate(made))
        doc, span = _spans(rows["doc"][covered], rows["lo"][covered], rows["n"][covered])
        keys, blobs = [], []
        if len(doc):
            keys.append(-1 - int(doc[0]) % buckets)
            blobs.append(doc.tobytes() + span.tobytes())
        rows = rows[first]
        bucket = _bucket(rows["h"], buckets)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, b in zip(cuts, [*cuts[1:], len(rows)]):
            keys.append(int(bucket[a]))
            blobs.append(pack(rows[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["_bucket", "_rows"])

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        made, size = [], 0
        for doc, raw in zip(batch.column(0).to_pylist(), byte_list(batch.column(1))):
            if doc is None or len(raw) < LENGTH:
                continue
            made.append(Anchors(raw, LENGTH, GRAM).rows(doc, hot))
            size += len(raw)
            if size >= SETTLE_BYTES:
                yield settled(made)
                made, size = [], 0
        if made:
            yield settled(made)

    return docs.mapInArrow(per_batch(lambda: step), "_bucket bigint, _rows binary")


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Rows (key, blob) in order of key, gathered by key; those of a negative key one at a time."""
    key, waiting = None, []
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k < 0:
                yield k, [blob]
                continue
            if k != key and waiting:
                yield key, waiting
                waiting = []
            key = k
            waiting.append(blob)
    if waiting:
        yield key, waiting


def _unpack(blobs: list[bytes]) -> np.ndarray:
    width = _ROW.itemsize
    out = np.empty(sum(len(b) // width for b in blobs), dtype=_ROW)
    at = 0
    for b in blobs:
        n, place = len(b) // width, 0
        for f in _ROW.names:
            out[f][at : at + n] = np.frombuffer(b, dtype=_ROW[f], count=n, offset=place)
            place += n * _ROW[f].itemsize
        at += n
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the entries of a bucket: covered spans, and the first occurrences of surroundings whose anchor has others, to ask for."""
    for key, blobs in _by_key(batches):
        if key < 0:
            doc, span = np.frombuffer(blobs[0], dtype=np.int64).reshape(2, -1)
            yield from _found(doc, span, False)
            continue
        rows, first, covered = _settle(_unpack(blobs))
        yield from _found(*_spans(rows["doc"][covered], rows["lo"][covered], rows["n"][covered]), False)
        rows = rows[first]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = rows["h"][1:] != rows["h"][:-1]
        run = np.cumsum(new) - 1
        ask = rows[np.bincount(run)[run] > 1]
        yield from _found(ask["doc"], ask["lo"].astype(np.int64) << 32 | (ask["lo"] + ask["n"]), True)


def _surroundings(buckets: int):
    """Of texts with the spans asked of them: (_bucket, _rows), the bytes of these spans by bucket of their anchor."""
    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        keys, blobs = [], []
        for doc, raw, asked in zip(batch.column(0).to_pylist(), byte_list(batch.column(1)), batch.column(2).to_pylist()):
            if not asked:
                continue
            own = Anchors(raw, LENGTH, GRAM)
            span = {(max(a - (LENGTH - GRAM), 0), min(a + LENGTH, own.n)): [] for a in own.at.tolist()}
            for a, h, b in zip(own.at.tolist(), own.grams, _bucket(own.grams, buckets).tolist()):
                span[max(a - (LENGTH - GRAM), 0), min(a + LENGTH, own.n)].append((h, b))
            for s in set(asked):
                lo, hi = s >> 32, s & 0xFFFFFFFF
                for h, b in span.get((lo, hi), ()):
                    keys.append(b)
                    blobs.append(h.tobytes() + np.array([doc, lo], dtype="<i8").tobytes() + raw[lo:hi])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["_bucket", "_rows"])

    return per_batch(lambda: step)


def _late_strings(segments: list[bytes], doc: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    ids, rank = np.unique(doc, return_inverse=True)
    return earlier_elsewhere(segments, (rank.astype(np.int64) << 32) + lo, LENGTH)


def _late_by_bytes(segments: list[bytes], doc: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    """The same for an anchor with more surroundings than a block holds: equal strings by their bytes, in order of place."""
    seen: dict[bytes, tuple[int, int]] = {}
    late: list[list[int]] = [[] for _ in segments]
    for i in np.lexsort((lo, doc)):
        raw, d, a = segments[i], int(doc[i]), int(lo[i])
        for o in range(len(raw) - LENGTH + 1):
            if seen.setdefault(raw[o : o + LENGTH], (d, a + o)) < (d, a + o):
                late[i].append(o)
    return [np.array(x, dtype=np.int64) for x in late]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered spans among the surroundings of a bucket, by blocks of whole anchors."""
    for _, blobs in _by_key(batches):
        h = np.array([int.from_bytes(b[:8], "little") for b in blobs], dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        h, blobs = h[order], [blobs[i] for i in order]
        head = np.array([np.frombuffer(b, dtype="<i8", count=2, offset=8) for b in blobs])
        segments = [b[24:] for b in blobs]
        ends = np.cumsum([len(s) + 1 for s in segments])
        cuts = [*np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])).tolist(), len(blobs)]
        begin = 0
        for i in range(1, len(cuts)):
            more = i + 1 < len(cuts)
            size = ends[cuts[i + 1] - 1] - (ends[begin - 1] if begin else 0) if more else 0
            if more and size <= BLOCK:
                continue
            part = slice(begin, cuts[i])
            big = sum(map(len, segments[part])) > BLOCK
            doc, lo = head[part, 0], head[part, 1]
            late = (_late_by_bytes if big else _late_strings)(segments[part], doc, lo)
            n = np.array([len(x) for x in late])
            yield from _found(*_spans(np.repeat(doc, n), np.repeat(lo, n) + np.concatenate(late), np.full(int(n.sum()), LENGTH)), False)
            begin = cuts[i]


def _frequent_anchors(texts: DataFrame) -> tuple[int, np.ndarray]:
    """About how many bytes of text there are, and the most frequent anchors, HOT at most, both from one text in SAMPLE by hash of the id.

    They decide how rows are dealt out, not what is found.
    """
    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        texts = byte_list(batch.column(1))
        grams = [np.unique(Anchors(raw, LENGTH, GRAM).grams) for raw in texts if len(raw) >= LENGTH]
        key, n = np.unique(np.concatenate(grams), return_counts=True) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        columns = [[None, *key.view(np.int64).tolist()], [len(texts), *n.tolist()], [sum(map(len, texts)), *[0] * len(key)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["_h", "_n", "_size"])

    some = texts.filter(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(SAMPLE)) == 0)
    counts = some.mapInArrow(per_batch(lambda: step), "_h bigint, _n bigint, _size bigint").groupBy("_h").agg(F.sum("_n").alias("_n"), F.sum("_size").alias("_size"))
    counts = materialise(counts.filter("_h IS NULL OR _n > 3"), "suffix-sample")
    whole = counts.filter("_h IS NULL").first()
    if whole is None:
        return 0, np.zeros(0, dtype=np.uint64)
    top = counts.filter(F.col("_h").isNotNull() & (F.col("_n") >= HOT_SHARE * whole["_n"])).orderBy(F.col("_n").desc(), "_h").limit(HOT).collect()
    return whole["_size"] * SAMPLE, np.array([r["_h"] for r in top], dtype=np.int64).view(np.uint64)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: DataFrame | None = None) -> DataFrame:
    """_id, _text (bytes), _spans array<bigint>: every text with the spans, unsorted and overlapping, of strings of LENGTH bytes that also begin earlier.

    carried: the same rows as _id, _text and more columns, to have these as well.
    """
    texts = carried if carried is not None else docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    size, hot = _frequent_anchors(narrow)
    buckets = max(LEAST_BUCKETS, 1 << max(0, (size // BUCKET_BYTES).bit_length()))
    met = _anchor_rows(narrow, buckets, hot).repartition("_bucket").sortWithinPartitions("_bucket").mapInArrow(_meet, _FOUND)
    met = materialise(met, "suffix-met")

    def of_document(spans: DataFrame, name: str) -> DataFrame:
        return spans.groupBy("_doc").agg(F.collect_list("_span").alias(name))

    asked = texts.join(of_document(met.filter("_ask"), "_asked"), F.col("_id") == F.col("_doc"), "left")
    # what is carried goes along, unused, so that both joins read the same shuffle of the texts
    carried_names = [c for c in texts.columns if c not in ("_id", "_text")]
    fetched = asked.select(F.col("_id").cast("long"), "_text", "_asked", *carried_names).mapInArrow(_surroundings(buckets), "_bucket bigint, _rows binary")
    # by number, as the work of a task is far more than its bytes say
    tasks = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compared = fetched.repartition(tasks, "_bucket").sortWithinPartitions("_bucket").mapInArrow(_compare, _FOUND)
    spans = met.filter("NOT _ask").unionByName(compared).select("_doc", "_span")
    return texts.join(of_document(spans, "_spans"), F.col("_id") == F.col("_doc"), "left").drop("_doc")


def cut(raw: bytes, spans: list[int] | None) -> tuple[bytes, int]:
    """raw without the bytes in spans, and how many runs went."""
    if not spans:
        return raw, 0
    kept, end, runs = [], 0, 0
    for s in sorted(spans):
        lo, hi = s >> 32, min(s & 0xFFFFFFFF, len(raw))
        if hi <= lo:
            continue
        if lo > end or not runs:
            runs += 1
            kept.append(raw[end:lo])
        end = max(end, hi)
    kept.append(raw[end:])
    return b"".join(kept), runs


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, kept binary, n_bytes, n_removed, n_spans: the bytes of every text that stay.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a text of smaller id, or earlier
    in the same. Strings are those of the input and never cross texts. Null texts count as empty. Ids are integers.
    Texts with a null id take no part and stay whole. Rows that repeat an id count as one text: equal rows have equal
    results and don't cover each other.
    """
    found = repeated_spans(docs, id_col, text_col).select("_id", "_text", "_spans")

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        raw = byte_list(batch.column(1))
        kept, runs = zip(*map(cut, raw, batch.column(2).to_pylist()))
        counts = [[len(r) for r in raw], [len(r) - len(k) for r, k in zip(raw, kept)], list(runs)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array(c, pa.int64()) for c in counts)], names=[id_col, "kept", "n_bytes", "n_removed", "n_spans"])

    kind = found.schema["_id"].dataType.simpleString()
    return found.mapInArrow(per_batch(lambda: step), f"`{id_col}` {kind}, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with only the bytes of text_col that stay; a character that lost some of its bytes goes whole. All rows and columns stay, n_chars is counted anew if there is one."""
    rest = [c for c in docs.columns if c != text_col]
    carried = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"), F.struct(*rest).alias("_rest"))
    found = repeated_spans(docs, id_col, text_col, carried)

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        kept = [cut(raw, spans)[0].decode("utf-8", "ignore") for raw, spans in zip(byte_list(batch.column(0)), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), batch.column(2)], names=["_kept", "_rest"])

    kind = found.schema["_rest"].dataType.simpleString()
    done = found.select("_text", "_spans", "_rest").mapInArrow(per_batch(lambda: step), f"_kept string, _rest {kind}")
    columns = {c: F.col("_rest")[c] for c in rest} | {text_col: F.col("_kept")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("_kept").cast(docs.schema["n_chars"].dataType)
    return done.select(*(columns[c].alias(c) for c in docs.columns))
