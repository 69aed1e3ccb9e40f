"""Repeated strings of a block of byte segments: breadth-first backward extension on its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

_SYMBOL_BITS, _FIRST = 9, 7  # seven symbols of nine bits make the first sort key


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text (symbols 0 to 256) in the order of the depth symbols, or somewhat more, that follow each; the end counts as symbol 0."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(_FIRST, np.uint64)])
    key = np.zeros(n, dtype=np.uint64)
    for i in range(_FIRST):
        key = (key << np.uint64(_SYMBOL_BITS)) | padded[i : i + n]
    reach = _FIRST
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]])
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64) + np.uint64(1)
        if reach >= depth or new.sum() == n - 1:
            return order
        behind = np.zeros(n, dtype=np.uint64)
        behind[: n - reach] = rank[reach:] if reach < n else 0
        key = (rank << np.uint64(32)) | behind
        reach *= 2


def repeat_classes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): positions in suffix order, and whether each begins a class of positions that are followed by the same depth symbols.

    Intervals of the suffix order that share a prefix are extended backwards through the transform, all those of one
    length before those of the next, so that each common-prefix length is found once, in increasing value: where an
    interval of prefix w got a new left end, the intervals of cw, for each symbol c before it, may get one. It stops
    at depth; what has no value by then shares at least depth symbols with its predecessor.
    """
    n = len(text)
    order = suffix_order(text, depth)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    back = rank[order - 1]  # the last-to-first mapping: where the suffix one symbol longer stands
    ahead = np.empty(n, dtype=np.int64)
    ahead[back] = np.arange(n)
    symbol = text[order]
    first = np.ones(n, dtype=bool)
    first[1:] = symbol[1:] != symbol[:-1]
    front = np.flatnonzero(first)
    for _ in range(1, depth):
        if not len(front):
            break
        ends = np.append(np.flatnonzero(first), n)
        sizes = ends[np.searchsorted(ends, front, side="right")] - front
        total = int(sizes.sum())
        at = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(front, sizes)
        reached = back[left + at]
        open_ = ~first[reached]
        reached, left = reached[open_], left[open_]
        front = np.unique(reached[ahead[reached - 1] < left])
        first[front] = True
    return order, first


def earlier_elsewhere(segments: list[bytes], keys: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each segment the offsets of its depth-byte strings that also begin at a smaller place in this block.

    keys[i] is the place of the first byte of segment i: an integer that grows with the place, one a byte.
    """
    lengths = np.array([len(s) for s in segments])
    joined = np.frombuffer(b"\0".join(segments) + b"\0", dtype=np.uint8).astype(np.int16) + 1
    starts = np.cumsum(lengths + 1) - lengths - 1
    joined[starts + lengths] = 0
    order, first = repeat_classes(joined, depth)
    owner = np.repeat(np.arange(len(segments)), lengths + 1)
    offset = np.arange(len(joined)) - starts[owner]
    whole = offset + depth <= lengths[owner]
    place = np.where(whole, keys[owner] + offset, np.iinfo(np.int64).max)
    ranked = place[order]
    least = np.minimum.reduceat(ranked, np.flatnonzero(first))
    late = np.empty(len(joined), dtype=bool)
    late[order] = ranked > least[np.cumsum(first) - 1]
    late &= whole
    return [np.flatnonzero(late[a : a + n]) for a, n in zip(starts.tolist(), lengths.tolist())]
