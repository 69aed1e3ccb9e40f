"""Near copies of texts: candidates by ball hashing of fingerprints, links by the Jaccard similarity of word shingles.

Texts of similarity 0.8 differ in about 15% of the bits of a SimHash fingerprint, too many for one ball. So each text has
TABLES short fingerprints, and two texts are candidates if those of any table differ in at most twice the radius of the
balls: at 0.8 that happens in a table with probability 0.47, in one of eight with 0.99. Every fingerprint emits the
variants in its ball, factored by leading bits as in simhash.py; those that meet on a variant are compared by one more
fingerprint, and what is left by their words.

Where more than NEAR + 1 texts hang together under a lead, each is compared with their middle first. Crowded texts that
hang together by a similarity of KIN are kin. Among kin, every text that is not in their largest group by then is compared
with all of them in blocks, through an index of shingles in memory, and only links leave a block. Crowded texts that share
a variant and are no kin are compared pair by pair. So no link between candidates is lost, and crowds emit no pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, materialise, per_batch, without
from .simhash import Forest, ball, components, meet, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
KIN = 0.4  # chance meetings are far below, so that kin don't grow together over the whole corpus
BLOCK_BYTES = 4 << 20  # of packed words, about, that one task indexes at once
TABLES, TABLE_BITS, RADIUS = 8, 32, 2
CHECK = 20  # of 64 bits, at which a pair is no more compared; at similarity 0.8 the mean is 9.7, the deviation 2.9
LEAST_LEAD, MOST_LEAD = 4, 24
GROUP = 1 << 20  # fingerprints under one lead, about, at which leads become longer
NEAR = 8
_ODD = np.random.default_rng(3).integers(0, 1 << 62, 1 + TABLES * TABLE_BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW = np.dtype([("fp", "<u4"), ("left", "u1"), ("check", "<u8"), ("node", "<i8"), ("comp", "<i8")])


def signature(hashes: list[int]) -> bytes:
    """64 bits to check by, then TABLES fingerprints: a bit is 1 if set in over half of the different hashes, mixed anew for every 64 bits."""
    own = np.unique(np.array(hashes, dtype=np.uint64))[:, None] * _ODD[None, :]
    own = (own ^ (own >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    own ^= own >> np.uint64(29)
    counts = np.unpackbits(own.astype("<u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(own)).tobytes()


def node_of(hashes: list[int]) -> int:
    """64 bits of a set of shingles: texts with the same set are one node."""
    return xxhash.xxh3_64_intdigest(np.unique(np.array(hashes, dtype="<u8")).tobytes()) - (1 << 63)


def _prints(rows: DataFrame) -> DataFrame:
    """_id, _node, _sig of every row of (_id, text) that has words."""
    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        hashes = [shingle_hashes(b, WORDS) for b in byte_list(batch.column(1))]
        keep = [i for i, h in enumerate(hashes) if h]
        columns = [batch.column(0).take(pa.array(keep, pa.int64())), pa.array([node_of(hashes[i]) for i in keep], pa.int64()), pa.array([signature(hashes[i]) for i in keep], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["_id", "_node", "_sig"])

    return rows.mapInArrow(per_batch(lambda: step), f"_id {rows.schema[0].dataType.simpleString()}, _node bigint, _sig binary")


def lead_bits(n: int) -> int:
    """So many that about GROUP of n fingerprints meet under a lead, or fewer."""
    return next((b for b in range(LEAST_LEAD, MOST_LEAD) if n * len(ball(b, RADIUS)) <= GROUP << b), MOST_LEAD)


def _lead_rows(nodes: DataFrame, bits: int) -> DataFrame:
    """_lead (table and leading bits), _rows (packed): for each node, the leads of its variants and the radius left behind them."""
    masks = ball(bits, RADIUS).astype(np.uint32)
    cost = np.bitwise_count(masks)

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
        fps = sig[:, 8:].copy().view("<u4").reshape(batch.num_rows, TABLES)
        row = np.zeros(batch.num_rows, dtype=_ROW)
        row["check"], row["node"], row["comp"] = sig[:, :8].copy().view("<u8").ravel(), batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for table in range(TABLES):
            row["fp"] = fps[:, table]
            lead = ((row["fp"] >> np.uint32(TABLE_BITS - bits))[:, None] ^ masks[None, :]).ravel()
            made = np.repeat(row, len(masks))
            made["left"] = np.tile(RADIUS - cost, len(row))
            order = np.argsort(lead, kind="stable")
            lead, made = lead[order], made[order]
            cuts = [0, *(np.flatnonzero(np.diff(lead)) + 1).tolist(), len(lead)]
            keys = (table << MOST_LEAD | lead[cuts[:-1]].astype(np.int64)).tolist()
            blobs = [b"".join(np.ascontiguousarray(made[f][a:b]).tobytes() for f in _ROW.names) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["_lead", "_rows"])

    return nodes.select("_node", "_sig", "_comp").mapInArrow(per_batch(lambda: step), "_lead bigint, _rows binary")


def _unpacked(blobs: list[bytes]) -> np.ndarray:
    out = np.empty(sum(len(b) for b in blobs) // _ROW.itemsize, dtype=_ROW)
    at = 0
    for b in blobs:
        n, place = len(b) // _ROW.itemsize, 0
        for f in _ROW.names:
            out[f][at : at + n] = np.frombuffer(b, dtype=_ROW[f], count=n, offset=place)
            place += n * _ROW[f].itemsize
        at += n
    return out


class _Pairs:
    """Pairs of rows that are near by their checks and in different components, each once."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, self.found = rows, []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        r = self.rows
        near = (r["comp"][i] != r["comp"][j]) & (np.bitwise_count(r["check"][i] ^ r["check"][j]) <= CHECK)
        i, j = i[near], j[near]
        if len(i):
            self.found.append(np.unique(np.minimum(i, j) * len(r) + np.maximum(i, j)))

    def some(self, variants: np.ndarray, owners: np.ndarray) -> None:
        """Of the rows that meet on each variant, each with its NEAR neighbours."""
        for d in range(1, NEAR + 1):
            at = np.flatnonzero(variants[d:] == variants[:-d])
            if not len(at):
                return
            self.add(owners[at], owners[at + d])

    def of_clusters(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs to compare, those of small clusters and those of crowded ones.

        A cluster is what the pairs found hang together. Up to NEAR + 1 rows have all their pairs; more rows are each
        paired with their middle only, the row that is nearest to what most of their bits are.
        """
        r, none = self.rows, np.zeros(0, np.int64)
        found = np.unique(np.concatenate(self.found)) if self.found else none
        if not len(found):
            return found, none
        forest = Forest(len(r))
        forest.join(found // len(r), found % len(r))
        sizes = np.bincount(forest.root, minlength=len(r))
        big = sizes[forest.root] > NEAR + 1
        crowded = np.flatnonzero(big)
        stars = [none]
        order = crowded[np.argsort(forest.root[crowded], kind="stable")]
        for own in np.split(order, np.flatnonzero(np.diff(forest.root[order])) + 1) if len(order) else ():
            bits = np.unpackbits(r["check"][own].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
            most = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(own)).view("<u8")[0]
            middle = own[np.argmin(np.bitwise_count(r["check"][own] ^ most))]
            others = own[own != middle]
            stars.append(np.minimum(others, middle) * len(r) + np.maximum(others, middle))
        return found[~big[found // len(r)]], np.unique(np.concatenate(stars))

    def every(self, variants: np.ndarray, owners: np.ndarray) -> None:
        """Of the rows that meet on each variant, all pairs of different components: each row outside the largest one with all rows."""
        starts = np.flatnonzero(np.concatenate([[True], variants[1:] != variants[:-1]]))
        ends = np.append(starts[1:], len(variants))
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            own = owners[a:b]
            kinds, comp, sizes = np.unique(self.rows["comp"][own], return_inverse=True, return_counts=True)
            if len(kinds) > 1:
                for i in own[comp != np.argmax(sizes)]:
                    self.add(np.full(len(own), i), own)


def _candidates(batches: Iterator[pa.RecordBatch], bits: int, first: bool) -> Iterator[pa.RecordBatch]:
    """Of packed rows in order of lead: pairs of nodes (_a, _b) to compare, and whether a crowd is why (_crowd)."""
    def close(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = _unpacked(blobs)
        rows = rows[np.argsort(rows["node"], kind="stable")]
        pairs = _Pairs(rows)
        meet(np.arange(len(rows)), rows["fp"].astype(np.uint64), rows["left"].astype(np.int64), TABLE_BITS - bits, pairs.some if first else pairs.every)
        few, stars = pairs.of_clusters() if first else (np.unique(np.concatenate([*pairs.found, np.zeros(0, np.int64)])), np.zeros(0, np.int64))
        found, crowd = np.concatenate([few, stars]), np.repeat([False, True], [len(few), len(stars)])
        a, b = rows["node"][found // max(len(rows), 1)], rows["node"][found % max(len(rows), 1)]
        for at in range(0, len(a), 100_000):
            cut = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(a[cut]), pa.array(b[cut]), pa.array(crowd[cut])], names=["_a", "_b", "_crowd"])

    key, waiting = None, []
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key and waiting:
                yield from close(waiting)
                waiting = []
            key = k
            waiting.append(blob)
    if waiting:
        yield from close(waiting)


def _meetings(nodes: DataFrame, bits: int, first: bool) -> DataFrame:
    dealt = _lead_rows(nodes, bits).repartition("_lead").sortWithinPartitions("_lead")
    return materialise(dealt.mapInArrow(partial(_candidates, bits=bits, first=first), "_a bigint, _b bigint, _crowd boolean").groupBy("_a", "_b").agg(F.max("_crowd").alias("_crowd")), "near-candidates")


def _shingles(packed: bytes) -> set[bytes]:
    words = zlib.decompress(packed).split(b" ")
    return {b" ".join(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))}


def _hung(pairs: list[tuple[int, int]], linked: bool) -> Iterable[pa.RecordBatch]:
    """A forest of what pairs hang together: one link for each node but one of a tree."""
    if pairs:
        nodes, at = np.unique(np.array(pairs), return_inverse=True)
        at = at.reshape(-1, 2)
        forest = Forest(len(nodes))
        forest.join(at[:, 0], at[:, 1])
        own = np.flatnonzero(forest.root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[forest.root[own]]), pa.array([linked] * len(own))], names=["_a", "_b", "_linked"])


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """_a, _b, _linked: forests of what the pairs (_a, _b) hang together whose texts (_node, _words) have SIMILARITY or more (_linked), or KIN."""
    def own(side: str) -> DataFrame:
        return texts.select(F.col("_node").alias(f"_n{side}"), F.col("_words").alias(f"_w{side}"))

    both = pairs.join(own("a"), F.col("_a") == F.col("_na")).join(own("b"), F.col("_b") == F.col("_nb")).select("_a", "_b", "_wa", "_wb")

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        known: dict[int, set[bytes]] = {}
        links, kin = [], []
        for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
            if len(known) > 500:
                known.clear()
            p = known[a] if a in known else known.setdefault(a, _shingles(x))
            q = known[b] if b in known else known.setdefault(b, _shingles(y))
            common = len(p & q)
            if common >= KIN * (len(p) + len(q) - common):
                kin.append((a, b))
            if common >= SIMILARITY * (len(p) + len(q) - common) - 1e-9:
                links.append((a, b))
        yield from _hung(links, True)
        yield from _hung(kin, False)

    return both.mapInArrow(per_batch(lambda: step), "_a bigint, _b bigint, _linked boolean")


class _Index:
    """Which of some texts have a shingle: their nodes, groups and hashes, as _compare() reads them."""

    def __init__(self, nodes: list[int], groups: list[int], hashes: list[np.ndarray]) -> None:
        self.nodes, self.groups = np.array(nodes, np.int64), np.array(groups, np.int64)
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        found = np.concatenate(hashes)
        order = np.argsort(found, kind="stable")
        self.keys, self.owners = found[order], np.repeat(np.arange(len(nodes)), self.sizes)[order]

    def similar(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the texts of SIMILARITY or more."""
        low, high = np.searchsorted(self.keys, hashes, "left"), np.searchsorted(self.keys, hashes, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(self.owners[at], minlength=len(self.nodes))
        return np.flatnonzero(common >= SIMILARITY * (len(hashes) + self.sizes - common) - 1e-9)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of block, those to index before those to look up: links (_a, _b) that hang groups together, one for each two groups that did not by then."""
    key, index, waiting, above = None, None, [], {}

    def top(group: int) -> int:
        while group in above:
            group = above[group]
        return group

    for batch in batches:
        links = []
        for *block, probe, node, group, words in zip(*(c.to_pylist() for c in batch.columns)):
            if block != key:
                key, index, waiting, above = block, None, [], {}
            hashes = np.unique(np.array(shingle_hashes(zlib.decompress(words), WORDS), dtype=np.uint64))
            if not probe:
                waiting.append((node, group, hashes))
                continue
            if waiting:
                index, waiting = _Index(*map(list, zip(*waiting))), []
            if index is None:  # no text fell into this block
                continue
            near = index.similar(hashes)
            groups, first = np.unique(index.groups[near], return_index=True)
            for other, at in zip(groups.tolist(), near[first].tolist()):
                x, y = top(group), top(other)
                if x != y:
                    above[max(x, y)] = min(x, y)
                    links.append((node, int(index.nodes[at])))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["_a", "_b"])


def _among_kin(crowd: DataFrame, rows: DataFrame, block_bytes: int) -> DataFrame:
    """Links (_a, _b) that hang together the groups (_comp) of texts of one _kin: all texts outside the largest group against all.

    Blocks hold about block_bytes of packed words; each text to look up goes to every block of its kin, each block to as
    many tasks as these texts need.
    """
    groups = crowd.groupBy("_kin", "_comp").agg(F.count("*").alias("_n")).groupBy("_kin").agg(F.count("*").alias("_groups"), F.max(F.struct("_n", "_comp"))["_comp"].alias("_main"))
    several = crowd.join(groups.filter("_groups > 1"), "_kin").select("_kin", "_node", "_least", "_comp", (F.col("_comp") != F.col("_main")).alias("_probe"))
    texts = _texts_of(rows, several.select("_node", "_least"))
    own = materialise(several.join(texts, "_node").select("_kin", "_node", "_comp", "_probe", "_words"), "near-kin-texts")
    blocks = lambda of: F.ceil(F.sum(of) / F.lit(block_bytes)).cast("int")
    plan = own.groupBy("_kin").agg(blocks(F.length("_words")).alias("_ts"), blocks(F.when(F.col("_probe"), F.length("_words"))).alias("_ps"))
    dealt = own.join(plan, "_kin")
    mine = lambda n: F.pmod(F.xxhash64("_node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = ("_node", "_comp", "_words")
    indexed = dealt.select("_kin", mine("_ts").alias("_t"), every("_ps").alias("_p"), F.lit(False).alias("_probe"), *rest)
    looked_up = dealt.filter("_probe").select("_kin", every("_ts").alias("_t"), mine("_ps").alias("_p"), F.lit(True).alias("_probe"), *rest)
    block = ("_kin", "_t", "_p")
    return indexed.unionByName(looked_up).repartition(*block).sortWithinPartitions(*block, "_probe").mapInArrow(_compare, "_a bigint, _b bigint")


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """_node, _words (lower case, packed) of the nodes of wanted (_node, _least), from one text of each."""
    found = rows.join(wanted, F.col("_id") == F.col("_least")).select("_text", "_node")

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        made = {}
        for raw, node in zip(byte_list(batch.column(0)), batch.column(1).to_pylist()):
            if node_of(shingle_hashes(raw, WORDS) or [0]) == node:  # an id may be repeated with another text
                made[node] = zlib.compress(b" ".join(raw.lower().split()))
        yield pa.RecordBatch.from_arrays([pa.array(made.keys(), pa.int64()), pa.array(made.values(), pa.binary())], names=["_node", "_words"])

    return found.mapInArrow(per_batch(lambda: step), "_node bigint, _words binary").groupBy("_node").agg(F.first("_words").alias("_words"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, group_id: one row per different id of a row with words and an id; group_id is the least id that can be reached.

    Texts are linked at a Jaccard similarity of SIMILARITY of their sets of WORDS-word shingles (a shorter text is one
    shingle; A-Z in lower case; words as in simhash.py). Candidates are found with a probability that rises with the
    similarity; each is then compared exactly. Null and empty texts have no group. An id that is repeated with
    different texts is in the least group of these. Sets of shingles are told apart by 64 bits.
    """
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    prints = materialise(_prints(rows), "near-prints")
    nodes = materialise(prints.groupBy("_node").agg(F.min("_id").alias("_least"), F.first("_sig").alias("_sig")), "near-nodes")
    bits = lead_bits(nodes.count())
    met = _meetings(nodes.withColumn("_comp", F.col("_node")), bits, True)
    pairs = met.select("_a", "_b")
    ends = lambda p: p.select(F.col("_a").alias("_node")).unionByName(p.select(F.col("_b").alias("_node"))).distinct()
    texts = lambda p: _texts_of(rows, nodes.select("_node", "_least").join(ends(p), "_node"))
    judged = materialise(_similar(pairs, materialise(texts(pairs), "near-texts")), "near-links")
    links = judged.filter("_linked").select("_a", "_b")
    roots = components(links, "near-components")
    crowded = ends(met.filter("_crowd"))
    if not crowded.isEmpty():
        kin = components(judged.select("_a", "_b"), "near-kin").select("_node", F.col("_root").alias("_kin"))
        crowd = nodes.join(crowded, "_node").join(roots, "_node", "left").join(kin, "_node", "left")
        crowd = materialise(crowd.select("_node", "_least", "_sig", F.coalesce("_root", "_node").alias("_comp"), F.coalesce("_kin", "_node").alias("_kin")), "near-crowd")
        strangers = _meetings(crowd.select("_node", "_sig", F.col("_kin").alias("_comp")), bits, False)
        strangers = materialise(strangers.select("_a", "_b").join(pairs, ["_a", "_b"], "left_anti"), "near-more")
        met_strangers = materialise(_similar(strangers, materialise(texts(strangers), "near-texts")), "near-links").filter("_linked").select("_a", "_b")
        links = links.unionByName(met_strangers).unionByName(materialise(_among_kin(crowd, rows, block_bytes), "near-links"))
        roots = components(links, "near-components")
    rooted = nodes.select("_node", "_least").join(roots, "_node", "left").withColumn("_comp", F.coalesce("_root", "_node"))
    least = rooted.groupBy("_comp").agg(F.min("_least").alias("_group"))
    groups = rooted.join(least, "_comp").select(F.col("_node").alias("_n"), "_group")
    found = prints.select("_id", "_node").join(groups, F.col("_node") == F.col("_n"))
    return found.groupBy(F.col("_id").alias(id_col)).agg(F.min("_group").alias("group_id"))


def one_of_each_near_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with only the rows of the least id of each group; rows without words or with a null id stay, and so do all columns."""
    return without(docs, id_col, near_groups(docs, id_col, text_col).filter(F.col(id_col) != F.col("group_id")).select(id_col))
