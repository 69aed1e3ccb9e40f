"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a variant in common that is within r bits of both, so it is
enough to meet on variants. Variants travel factored: those of a fingerprint that share their leading bits go to
the shuffle as one row under these bits, and the rest of the bits is varied where they arrive, within what is left
of r. Every fingerprint reaches every variant of its ball that way, with some dozens of rows instead of thousands.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, forget, materialise, per_batch, skew_safe_lookup, without

BITS, SEED, SHINGLE, RADIUS = 64, 42, 4, 4
LEAST_LEAD, MOST_LEAD = 12, 24  # leading bits that variants are shuffled by, more for more fingerprints
AT_ONCE = 1 << 21  # variants that a task holds at once
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(raw: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of each run of size words, joined by spaces, repeats included; of the whole sequence if it is shorter; none without words."""
    words = raw.lower().split()  # A-Z only, and [\x20\x09-\x0D] only, as these are bytes
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), dtype=np.int64, count=len(words)) - 1).tolist()
    hash64 = xxhash.xxh64_intdigest
    return [hash64(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())]


def fingerprint(hashes: list[int]) -> int:
    """A bit is 1 if set in over half the hashes; zero without any."""
    if not hashes:
        return 0
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _fp bigint (the 64 bits, signed): one row per row of docs; null texts count as empty."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col))

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        fps = np.array([fingerprint(shingle_hashes(b)) for b in byte_list(batch.column(1))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["_id", "_fp"])

    return rows.mapInArrow(per_batch(lambda: step), f"_id {rows.schema[0].dataType.simpleString()}, _fp bigint")


def ball(bits: int, radius: int) -> np.ndarray:
    """All masks over the lowest bits with at most radius of them set."""
    return np.array([sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(bits), k)], dtype=np.uint64)


class Forest:
    """Least label of each of n nodes under links given as arrays; labels only fall."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := self.root[self.root]).tolist() != self.root.tolist():
                self.root = up


def meet(at: np.ndarray, fp: np.ndarray, left: np.ndarray, bits: int, runs) -> None:
    """Find fingerprints that share a variant: those of rows at vary in their lowest bits, each within what is left of its radius. runs(variants, rows) takes the variants in order, with their rows.

    Too many variants for one go are split by their next four bits, so that memory is bounded for any number of
    fingerprints under one lead.
    """
    sizes = np.array([len(_ball(bits, r)) for r in range(int(left.max()) + 1)]) if len(at) else np.zeros(1, int)
    if len(at) < 2:
        return
    if sizes[left].sum() > AT_ONCE and bits >= 4:
        low = bits - 4
        nibble = (fp >> np.uint64(low)) & np.uint64(15)
        for t in range(16):
            cost = np.bitwise_count(nibble ^ np.uint64(t)).astype(np.int64)
            inside = cost <= left
            if inside.sum() > 1:
                meet(at[inside], fp[inside], (left - cost)[inside], low, runs)
        return
    mask = np.uint64((1 << bits) - 1)
    variants, owners = [], []
    for r in range(len(sizes)):
        own = np.nonzero(left == r)[0]
        if len(own):
            variants.append(((fp[own] & mask)[:, None] ^ _ball(bits, r)[None, :]).ravel())
            owners.append(np.repeat(at[own], sizes[r]))
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variants)
    runs(variants[order], owners[order])


_balls: dict[tuple[int, int], np.ndarray] = {}


def _ball(bits: int, radius: int) -> np.ndarray:
    if (bits, radius) not in _balls:
        _balls[bits, radius] = ball(bits, min(radius, bits))
    return _balls[bits, radius]


def lead_bits(n: int) -> int:
    """So many that some dozens to some thousands of n fingerprints meet under a lead."""
    return min(MOST_LEAD, max(LEAST_LEAD, n.bit_length() - 6))


def _lead_rows(classes: DataFrame, radius: int, bits: int) -> DataFrame:
    """_lead, _fp, _rep, _left: for each class of equal fingerprints, the leads of its variants and the radius left behind them."""
    masks = ball(bits, radius)
    cost = np.bitwise_count(masks)

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        fp = batch.column(0).to_numpy().view(np.uint64)
        lead = ((fp >> np.uint64(BITS - bits))[:, None] ^ masks[None, :]).ravel()
        which = pa.array(np.repeat(np.arange(len(fp)), len(masks)))
        left = np.tile(radius - cost.astype(np.int32), len(fp))
        for a in range(0, len(lead), 100_000):
            part = which[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(lead[a : a + 100_000].astype(np.int32)), batch.column(0).take(part), batch.column(1).take(part), pa.array(left[a : a + 100_000])], names=["_lead", "_fp", "_rep", "_left"])

    kind = classes.schema["_rep"].dataType.simpleString()
    return classes.select("_fp", "_rep").mapInArrow(per_batch(lambda: step), f"_lead int, _fp bigint, _rep {kind}, _left int")


def _verified_links(batches: Iterator[pa.RecordBatch], limit: int, lead_bits: int) -> Iterator[pa.RecordBatch]:
    """Of rows in order of lead: links (_a, _b), _b < _a, from each class to the least one that it hangs together with under a lead."""
    def close(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        order = np.argsort(t["_rep"].to_numpy(), kind="stable")  # so that the least index is the least class
        rep = t["_rep"].to_numpy()[order]
        fp = t["_fp"].to_numpy()[order].view(np.uint64)
        forest = Forest(len(rep))

        def links(variants: np.ndarray, owners: np.ndarray) -> None:
            same = np.nonzero(variants[1:] == variants[:-1])[0]  # neighbours do: all that share a variant are near each other
            i, j = owners[same], owners[same + 1]
            near = np.bitwise_count(fp[i] ^ fp[j]) <= limit
            pairs = np.unique(i[near].astype(np.int64) * len(rep) + j[near])
            forest.join(pairs // len(rep), pairs % len(rep))

        meet(np.arange(len(fp)), fp, t["_left"].to_numpy()[order].astype(np.int64), BITS - lead_bits, links)
        hung = np.nonzero(forest.root != np.arange(len(rep)))[0]
        if len(hung):
            yield pa.RecordBatch.from_arrays([pa.array(rep[hung]), pa.array(rep[forest.root[hung]])], names=["_a", "_b"])

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        lead = batch.column(0).to_numpy()
        cuts = [0, *(np.nonzero(lead[1:] != lead[:-1])[0] + 1).tolist(), len(lead)]
        for a, b in zip(cuts, cuts[1:]):
            if waiting and waiting[0].column(0)[0].as_py() != lead[a]:
                yield from close(waiting)
                waiting = []
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield from close(waiting)


def components(links: DataFrame, label: str) -> DataFrame:
    """_node, _root of every node with a link (_a, _b), where _root is the least node of its component.

    Large-star and small-star steps in turn, as joins with the least neighbour of each node, written after each
    step, until nothing changes. A node's neighbours are never gathered; a node that very many hang on is split by
    the engine's handling of skewed joins, as both sides are read from tables.
    """
    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("_a").agg(F.min("_b").alias("_m")).select(F.col("_a").alias("_n"), "_m")

    def tally(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first()

    links = materialise(links.filter("_a <> _b").select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).distinct(), label)
    seen = tally(links)
    while True:
        both = links.unionByName(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        low = materialise(least(both), f"{label}-least")
        # large star: neighbours above a node move to its least neighbour, or to itself if it is the least
        large = both.filter("_b > _a").join(low, F.col("_a") == F.col("_n")).select(F.col("_b").alias("_a"), F.least("_m", F.col("_n")).alias("_b"))
        large = materialise(large.filter("_a <> _b").distinct(), f"{label}-large")
        # small star: a node and its neighbours below move to the least of these
        m = materialise(least(large), f"{label}-least")
        small = large.join(m, F.col("_a") == F.col("_n")).select(F.explode(F.array(F.struct(F.col("_b").alias("_a"), F.col("_m").alias("_b")), F.struct("_a", F.col("_m").alias("_b")))).alias("_e"))
        before, links = links, materialise(small.select("_e.*").filter("_a <> _b").distinct(), label)
        forget(before, low, large, m)
        now = tally(links)
        if now == seen:
            return links.select(F.col("_a").alias("_node"), F.col("_b").alias("_root"))
        seen = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = RADIUS) -> DataFrame:
    """id, fingerprint (16 lowercase hex digits), component_id: one row per row of docs.

    Rows are linked if their fingerprints differ in at most distance bits; component_id is the least id that can be
    reached, itself included. Words are lower-cased (A-Z only), shingles have four words, all in common with the
    contract of the query. Null and empty texts have fingerprint zero and are linked like others. Repeated ids give
    repeated rows. A null id gets a component_id only from other rows. Ids must be integers.
    """
    if distance % 2:
        raise ValueError("distance must be even: half of it is the radius of the balls")
    prints = materialise(fingerprints(docs, id_col, text_col), "simhash-prints")
    classes = materialise(prints.groupBy("_fp").agg(F.min("_id").alias("_rep"), F.count("*").alias("_size")), "simhash-classes")
    bits = lead_bits(classes.count())
    met = _lead_rows(classes.filter("_rep IS NOT NULL"), distance // 2, bits).repartition("_lead").sortWithinPartitions("_lead")
    kind = classes.schema["_rep"].dataType.simpleString()
    links = met.mapInArrow(lambda it: _verified_links(it, distance, bits), f"_a {kind}, _b {kind}")
    roots = components(links, "simhash-links")
    rooted = classes.join(roots, F.col("_rep") == F.col("_node"), "left").select("_fp", "_size", F.coalesce("_root", "_rep").alias("_component"))
    rooted = materialise(rooted.withColumn("_key", F.hex("_fp")).drop("_fp"), "simhash-roots")
    found = skew_safe_lookup(prints.withColumn("_key", F.hex("_fp")), "_key", rooted.withColumnRenamed("_key", "_rkey"), "_rkey", "_size")
    return found.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.col("_key"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = RADIUS) -> DataFrame:
    """docs with only the row of least id of each component; rows with a null id stay."""
    return without(docs, id_col, near_duplicates(docs, id_col, text_col, distance).filter(F.col(id_col) != F.col("component_id")).select(id_col))
