"""Host suffix arrays: which tokens of a host's pages stand in strings that its other pages have too.

The token streams of a host are concatenated and their suffixes sorted, to the least length of a repeat. Neighbours in
that order that agree so far are one class of equal strings; a class with two different pages in it is a repeat. A host
of more than BLOCK tokens is cut into blocks with a suffix array each: strings that a block has on one page only ask
the host's other blocks by their hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BLOCK = 1 << 16  # tokens in one suffix array
HEAVY = 1024  # hosts with most tokens that are dealt out to many tasks; they are broadcast
_ROUND = np.uint64(0x9E3779B97F4A7C15)


def ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys, whether each in that order differs from the one before, and the rank of each key from 1."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return order, new, rank


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): positions in the order of the depth tokens that follow each, and where these differ from the ones before.

    Sorted by one token, then by twice as many at a time; the last step overlaps, so that it is depth exactly.
    """
    order, new, rank = ranks(tokens)
    reach = 1
    while reach < depth:
        step = min(reach, depth - reach)
        behind = np.zeros(len(rank), dtype=np.int64)
        behind[: max(len(rank) - step, 0)] = rank[step:]
        order, new, rank = ranks(rank << 32 | behind)
        reach += step
    return order, new


class Vocabulary:
    """Numbers and hashes of the words of a block."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}

    def __call__(self, words: list[str]) -> list[int]:
        return [self.number.setdefault(w, len(self.number) + 1) for w in words]

    def hashes(self) -> np.ndarray:
        """By number; 0 has none."""
        return np.array([0, *(xxhash.xxh64_intdigest(w.encode()) for w in self.number)], dtype=np.uint64)


def string_hashes(word_hashes: np.ndarray, depth: int) -> np.ndarray:
    """64 bits of the depth words from each position on."""
    n = len(word_hashes) - depth + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(depth if n > 0 else 0):
        out = (out ^ word_hashes[i : i + n]) * _ROUND
        out ^= out >> np.uint64(29)
    return out


def _whole(streams: list[list[str]], depth: int) -> np.ndarray:
    """Token positions of a page, counted over its streams, where depth tokens follow in one stream."""
    found, first = [], 0
    for words in streams:
        found.append(np.arange(first, first + max(len(words) - depth + 1, 0)))
        first += len(words)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def page_hashes(streams: list[list[str]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a string of depth tokens begins, and the hashes of these strings."""
    words = Vocabulary()
    numbers = np.array(words([w for s in streams for w in s]), dtype=np.int64)
    at = _whole(streams, depth)
    return at, string_hashes(words.hashes()[numbers], depth)[at] if len(at) else np.zeros(0, np.uint64)


def block_repeats(pages: list[list[list[str]]], about: list[int], depth: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of the pages of a block, each with its streams: positions where strings begin that two different pages have, the hashes of all other strings, and (for all pages) the hashes of the first.

    Pages about the same are one page.
    """
    words, numbers, owner, local, starts = Vocabulary(), [], [], [], []
    size = 0
    for i, streams in enumerate(pages):
        own = words([w for s in streams for w in s])
        at = _whole(streams, depth)
        numbers += [*own, 0]
        starts.append(at + size)
        owner.append(np.full(len(at), i))
        local.append(at)
        size += len(own) + 1
    tokens = np.array(numbers, dtype=np.int64)
    order, new = suffix_array(tokens, depth)
    begins = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    page_at = np.full(len(tokens), -1)
    page_at[begins] = np.concatenate(owner) if owner else 0
    kinds = np.unique(np.array(about, dtype=np.int64), return_inverse=True)[1]
    inside = page_at[order] >= 0  # strings that reach into the next stream are none
    cls = (np.cumsum(new) - 1)[inside]
    at = order[inside]
    kind = kinds[page_at[at]]
    low, high = np.full(len(tokens) + 1, len(pages)), np.full(len(tokens) + 1, -1)
    np.minimum.at(low, cls, kind)
    np.maximum.at(high, cls, kind)
    shared = np.zeros(len(tokens), dtype=bool)
    shared[at] = low[cls] < high[cls]
    hashes = string_hashes(words.hashes()[tokens], depth)
    found = [own[shared[s]] for own, s in zip(local, starts)]
    asks = [np.unique(hashes[s[~shared[s]]]) if len(s) else np.zeros(0, np.uint64) for s in starts]
    told = begins[shared[begins]]
    return found, asks, np.unique(hashes[told]) if len(told) else np.zeros(0, np.uint64)


_SCHEMA = "_row binary, _host string, _about bigint, _found array<int>, _asks array<bigint>, _tells array<bigint>"
_LISTS = pa.list_(pa.int32()), pa.list_(pa.int64())


def _of_hosts(depth: int, block: int):
    """Rows (_host, _salt, _row, _about, _dealt, _streams) in order of host and salt: block by block, _SCHEMA of its pages.

    A block of a host that has no other asks nothing.
    """
    def emit(host: str, rows: list[tuple], alone: bool) -> pa.RecordBatch:
        found, asks, tells = block_repeats([r[2] for r in rows], [r[1] for r in rows], depth)
        none = np.zeros(0, np.int64)
        told = [none if alone or i else tells.view(np.int64) for i in range(len(rows))]
        asked = [none if alone else a.view(np.int64) for a in asks]
        columns = [pa.array([r[0] for r in rows], pa.binary()), pa.array([host] * len(rows), pa.string()), pa.array([r[1] for r in rows], pa.int64())]
        columns += [pa.array([f.astype(np.int32) for f in found], _LISTS[0]), pa.array(asked, _LISTS[1]), pa.array(told, _LISTS[1])]
        return pa.RecordBatch.from_arrays(columns, names=["_row", "_host", "_about", "_found", "_asks", "_tells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, rows, size, cut = None, [], 0, False
        for batch in batches:
            for h, row, about, dealt, streams in zip(*(batch.column(c).to_pylist() for c in ("_host", "_row", "_about", "_dealt", "_streams"))):
                words = [s.split(" ") for s in streams]
                n = sum(map(len, words))
                if rows and (h != host or size + n > block):
                    cut = cut or h == host
                    yield emit(host, rows, not cut)
                    cut = cut and h == host
                    rows, size = [], 0
                cut = cut or dealt
                host = h
                rows.append((row, about, words))
                size += n
        if rows:
            yield emit(host, rows, not cut)

    return run


def repeated_strings(streams: DataFrame, depth: int, block: int | None = None) -> DataFrame:
    """_row, _found array<int>, _elsewhere array<bigint>: of every key _row of (_row, _host, _about, _tokens, _streams), the positions (over all its streams) where strings of depth tokens begin that the host's other pages have too, and the hashes of more such strings.

    _found comes from the suffix array of the page's own block, _elsewhere from the host's other blocks. Pages of the
    same _about are one page. A host of more tokens than a block, among the HEAVY largest, is dealt to many tasks by
    row; any other holds less than one HEAVYth of the tokens, and one task goes over it block by block.
    """
    block = block or BLOCK
    sizes = streams.groupBy("_host").agg(F.sum("_tokens").alias("_n")).filter(F.col("_n") > block)
    heavy = sizes.orderBy(F.col("_n").desc(), "_host").limit(HEAVY).select(F.col("_host").alias("_h"), F.ceil(F.col("_n") / block).alias("_parts"))
    dealt = streams.join(F.broadcast(heavy), F.col("_host") == F.col("_h"), "left").withColumn("_dealt", F.coalesce(F.col("_parts") > 1, F.lit(False)))
    dealt = dealt.withColumn("_salt", F.when(F.col("_dealt"), F.pmod(F.xxhash64("_row"), F.col("_parts"))).otherwise(0))
    sent = dealt.select("_host", "_salt", "_row", "_about", "_dealt", "_streams").repartition("_host", "_salt").sortWithinPartitions("_host", "_salt", "_row")
    blocks = materialise(sent.mapInArrow(_of_hosts(depth, block), _SCHEMA), "html-blocks")
    asked = blocks.select("_row", "_host", "_about", F.explode("_asks").alias("_string"))
    told = blocks.select("_host", F.explode("_tells").alias("_string"))
    one = asked.groupBy("_host", "_string").agg(F.min("_about").alias("_lo"), F.max("_about").alias("_hi")).select("_host", "_string", (F.col("_lo") < F.col("_hi")).alias("_many"))
    shared = one.unionByName(told.withColumn("_many", F.lit(True))).groupBy("_host", "_string").agg(F.max("_many").alias("_many")).filter("_many")
    answers = asked.select("_row", "_host", "_string").join(shared.select("_host", "_string"), ["_host", "_string"])
    more = answers.groupBy("_row").agg(F.collect_set("_string").alias("_elsewhere"))
    # rows of the same key differ in which block they were in at most, and each found all there is with what it asked
    return blocks.groupBy("_row").agg(F.first("_found").alias("_found")).join(more, "_row", "left")
