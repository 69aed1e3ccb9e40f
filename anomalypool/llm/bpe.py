"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder.

What a merge makes can only be undone from the right, by an earlier merge that takes a token on its right edge together
with text beyond. Following such merges in order of rank bounds how far to the right of a token text can matter, for
each token of the vocabulary: `Merges.need`, whose greatest, `Merges.lookahead`, suffices for the whole merge list. The
transducer reads bytes, emits a token once as many bytes as it needs have been read behind it, and goes on from there as
from a fresh start, since no merge crosses the end of a token of the result. So it holds a bounded number of bytes
whatever it reads. Every pre-token goes through it; the end of a pre-token is an end of its input.
"""

from __future__ import annotations

import codecs
import json
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

#: Fixed values of the byte-level format: the split pattern, and which bytes stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))

LOW, NEVER, NO_RANK = (1 << 32) - 1, 1 << 80, 1 << 30
CHUNK_CACHE = 150_000
UNSPLIT = 1 << 19  # characters that the tiktoken library may split: it panics at a run of a million of white space
LITTLE = [f"<{n}I" for n in range(25)]
READ = 256  # bytes that the transducer reads at a time


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files, and the byte: printable ones are themselves, the others follow from 256 on."""
    shown = [b for span in PRINTABLE for b in span]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """A merge list over bytes: pair of ids -> (rank, id), the bytes of each id, and the lookahead that suffices."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("content")}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            if token not in self.special:
                self.bytes_of[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [0] * 256
        for c, b in symbols.items():
            self.byte_id[b] = vocab[c]
        self.first_ids = np.array(self.byte_id)
        self.pairs: dict[int, int] = {}  # the ids of both in one number -> rank and id made in one number
        for rank, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]):
            self.pairs[vocab[a] << 32 | vocab[b]] = rank << 32 | vocab[a + b]
        pairs = np.array([(k >> 32) * self.size + (k & LOW) for k in self.pairs] + [1 << 62])  # the last is above all
        ranks = np.array([v >> 32 for v in self.pairs.values()] + [NO_RANK])
        by_pair = np.argsort(pairs)
        self.sorted_pairs, self.sorted_ranks = pairs[by_pair], ranks[by_pair]
        self.made = np.zeros(len(spec["model"]["merges"]) + 1, np.int64)
        self.made[ranks[:-1]] = [v & LOW for v in self.pairs.values()]
        self.need = self._needs()
        self.lookahead = max(self.need)

    def _needs(self) -> list[int]:
        """For each id, how many bytes behind it suffice to tell that it stays.

        A merge (a, b) stands or falls with what was there at its rank: whether b had come about (inner[b]) and was
        not taken by an earlier merge with text behind it (reach[b], of the merges so far). Once it is done, only
        merges of the token made matter.
        """
        reach = [0] * self.size  # bytes right of an id that the merges so far with it on their left can depend on
        inner = [0] * self.size  # the same of the merges that the id comes about by
        for pair, made in self.pairs.items():  # in order of rank
            a, b, made = pair >> 32, pair & LOW, made & LOW
            right = max(inner[b], reach[b])
            inner[made] = max(inner[made], right)
            reach[a] = max(reach[a], len(self.bytes_of[b]) + right)
        return [max(x) for x in zip(inner, reach)]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of bytes that end here: the pair of least rank first, the leftmost among equals."""
        ids = [self.byte_id[b] for b in piece]
        get = self.pairs.get
        ranks = [get(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            made = ids[i] = best & LOW
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | made, NEVER)
            if i < len(ranks):
                ranks[i] = get(made << 32 | ids[i + 1], NEVER)
        return ids

    def settled(self, waiting: bytes, ids: list[int]) -> tuple[int, int]:
        """How many of the first ids that bytes make no later byte can change, and how many bytes those have."""
        need, bytes_of, read, end, done, n = self.need, self.bytes_of, len(waiting), 0, 0, 0
        for i in ids:
            end += len(bytes_of[i])
            if end + need[i] > read:
                break
            n, done = n + 1, end
        return n, done

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; NO_RANK where they don't merge."""
        pair = left * self.size + right
        at = np.searchsorted(self.sorted_pairs, pair)
        return np.where(self.sorted_pairs[at] == pair, self.sorted_ranks[at], NO_RANK)

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """merge() of each, all a step at a time together. Those that are done leave."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, owner = self.first_ids[np.frombuffer(b"".join(pieces), np.uint8)], np.flatnonzero(sizes)
        n = sizes[owner]
        rank = np.full(len(ids), NO_RANK)
        rank[:-1] = self._look(ids[:-1], ids[1:])
        rank[np.cumsum(n) - 1] = NO_RANK
        left_ids, left_owners = [ids[:0]], [owner[:0]]
        while len(owner):
            begin = np.cumsum(n) - n
            least = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), begin)
            at, best = least & LOW, least >> 32
            go = best < NO_RANK
            stay = np.ones(len(ids), bool)
            if not go.all():
                gone = np.repeat(~go, n)
                left_ids.append(ids[gone]), left_owners.append(np.repeat(owner[~go], n[~go]))
                stay[gone] = False
                at, best, n, owner = at[go], best[go], n[go], owner[go]
            at = at - begin[go]
            stay[at + begin[go] + 1] = False
            ids[at + begin[go]] = self.made[best]
            ids, rank, n = ids[stay], rank[stay], n - 1
            begin = np.cumsum(n) - n
            rank[begin + n - 1] = NO_RANK
            inner = at < n - 1
            i = (begin + at)[inner]
            rank[i] = self._look(ids[i], ids[i + 1])
            i = (begin + at)[at > 0]
            rank[i - 1] = self._look(ids[i - 1], ids[i])
        owner = np.concatenate(left_owners)
        flat = np.concatenate(left_ids)[np.argsort(owner, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(owner, minlength=len(pieces))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Transducer:
    """Bytes in, ids out, each as soon as no later byte can change it."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.waiting, self.open = b"", []  # bytes read behind the last token emitted, and what they make if no more come

    def feed(self, data: bytes) -> list[int]:
        m = self.merges
        waiting = self.waiting + data if self.waiting else data
        ids = m.merge(waiting)
        n, done = m.settled(waiting, ids)
        self.waiting, self.open = waiting[done:], ids[n:]
        return ids[:n]

    def close(self) -> list[int]:
        """The ids of what is left, as the input ends; the next feed begins anew."""
        out = self.open
        self.waiting, self.open = b"", []
        return out

    def whole(self, piece: bytes, read: int = READ) -> Iterator[int]:
        """The ids of one input, read bytes at a time."""
        for at in range(0, len(piece), read):
            yield from self.feed(piece[at : at + read])
        yield from self.close()


class Transducers:
    """A transducer for each of many inputs, which read and merge together."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges

    def whole(self, pieces: list[bytes], read: int = READ) -> list[list[int]]:
        """The ids of each input."""
        out: list[list[int]] = [[] for _ in pieces]
        going, waiting, at = range(len(pieces)), [piece[:read] for piece in pieces], read
        while going:
            made = self.merges.merge_all(waiting)
            more = []
            for i, held, ids in zip(going, waiting, made):
                if len(pieces[i]) > at:
                    n, done = self.merges.settled(held, ids)
                    ids = ids[:n]
                    more.append((i, held[done:] + pieces[i][at : at + read]))
                out[i] += ids
            going, waiting, at = [i for i, _ in more], [held for _, held in more], at + read
        return out


@lru_cache(maxsize=4)
def load_merges(path: str) -> Merges:
    return Merges(path)


def segments(text: str, size: int = 1 << 16) -> Iterator[str]:
    """text in parts of about size characters, cut where a pre-token must end: before a space between two characters that aren't white space."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while cut < len(text) - 1 and not (text[cut] == " " and not text[cut - 1].isspace() and not text[cut + 1].isspace()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return np.array(ids, dtype="<u4").tobytes() if len(ids) > 24 else struct.pack(LITTLE[len(ids)], *ids)


def as_bytes_and_decimals(ids: list[int]) -> tuple[bytes, str]:
    return as_bytes(ids), ",".join(map(str, ids))


def _empty(found: list) -> Iterator[int]:
    """Where a list has None."""
    i = -1
    try:
        while True:
            yield (i := found.index(None, i + 1))
    except ValueError:
        return


class Encoder:
    """Text to ids, chunk by chunk, each chunk's ids in the form that render() gives them.

    A chunk is what lies between such cuts as segments() uses, or else a pre-token; a bounded memory of recent chunks
    saves most of the work. encode_chunks encodes those that are not in memory: the transducers by default. With
    encode_part, what lies between the cuts of segments() is encoded as it is, and nothing is kept in memory.
    """

    def __init__(self, merges: Merges, encode_chunks: Callable[[list[str]], list[list[int]]] | None = None, render: Callable[[list[int]], object] = as_bytes, memory: int = CHUNK_CACHE, encode_part: Callable[[str], list[int] | array] | None = None) -> None:
        self.merges, self.memory, self.render, self.encode_part, self.transducers = merges, memory, render, encode_part, Transducers(merges)
        self.encode_chunks = encode_chunks or self._transduce
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None
        self.uneven = regex.compile(r" (?:\s|(?<=\s ))")  # white space beside a space
        self.spaced: list[dict[str, object]] = [{}, {}]  # chunks behind a space, which is left out of the key: young, old
        self.plain: list[dict[str, object]] = [{}, {}]  # all others
        self.pieces: dict[str, tuple[int, ...]] = {}  # the transducers' recent pre-tokens

    def _transduce(self, chunks: list[str]) -> list[list[int]]:
        known, split = self.pieces, list(map(self.split.findall, chunks))
        if len(known) >= self.memory:
            known.clear()
        fresh = list(dict.fromkeys([p for pieces in split for p in pieces if p not in known]))
        made = dict(zip(fresh, map(tuple, self.transducers.whole([p.encode() for p in fresh]))))  # tuples of numbers are nothing that the collector of cycles looks at again
        known.update(made)
        out = [known[pieces[0]] if len(pieces) == 1 else [i for p in pieces for i in known[p]] for pieces in split]
        for p in fresh:
            if len(p) > 64:
                del known[p]
        return out

    def _fill(self, asked: list[tuple[list[str], list | None, str]]) -> list[list]:
        """What render() makes of chunks, in lists of (chunks, their memory, what is before each); without a memory they are that already."""
        filled, missing = [], []
        fresh: dict[str, object] = {}
        for keys, memory, lead in asked:
            if memory is None:
                filled.append(keys)
                continue
            young, old = memory
            found = list(map(young.get, keys))
            for i in _empty(found):
                key = keys[i]
                x = old.get(key)
                if x is None:
                    name = lead + key
                    fresh[name] = None
                    missing.append((found, i, name, key, young))
                else:
                    young[key] = found[i] = x
            filled.append(found)
        if fresh:
            names = list(fresh)
            fresh = dict(zip(names, map(self.render, self.encode_chunks(names))))
            for found, i, name, key, young in missing:
                found[i] = made = fresh[name]
                if len(key) <= 64:
                    young[key] = made
        for memory in (self.spaced, self.plain):
            if len(memory[0]) > self.memory:
                memory[0], memory[1] = {}, memory[0]
        return filled

    def _ordinary(self, text: str) -> Iterator[tuple]:
        """The chunks of a text without special tokens, part by part, as _fill() takes them."""
        for part in segments(text):
            if self.encode_part:
                yield [self.render(self.encode_part(part))], None, ""
                continue
            if self.uneven.search(part):
                yield self.split.findall(part), self.plain, ""
                continue
            first, *rest = part.split(" ")
            if first:
                yield [first], self.plain, ""
            if rest:
                yield rest, self.spaced, " "

    def _asked(self, text: str) -> Iterator[tuple]:
        if not text:
            return
        if self.special is None or not self.special.search(text):
            yield from self._ordinary(text)
            return
        at = 0
        for m in self.special.finditer(text):
            if m.start() > at:
                yield from self._ordinary(text[at : m.start()])
            yield [self.render([self.merges.special[m[0]]])], None, ""
            at = m.end()
        if at < len(text):
            yield from self._ordinary(text[at:])

    def parts(self, text: str) -> Iterator[list]:
        """The ids of text, in lists of what render() makes; a special token's string is that token, as the tokenizers library reads it."""
        for asked in self._asked(text):
            yield from self._fill([asked])

    def many(self, texts: Iterable[str], size: int = 1 << 19) -> Iterator[Iterable[list]]:
        """parts() of each text. Chunks of texts that have size characters together are encoded together; longer texts go part by part."""
        held, n = [], 0

        def out() -> Iterator[Iterable[list]]:
            filled = iter(self._fill([x for asked in held for x in asked]))
            for asked in held:
                yield [next(filled) for _ in asked]

        for text in texts:
            if n + len(text) > size and held:
                yield from out()
                held, n = [], 0
            if len(text) > size:
                yield self.parts(text)
            else:
                held.append(list(self._asked(text)))
                n += len(text)
        if held:
            yield from out()

    def ids(self, text: str) -> np.ndarray:
        """With as_bytes: all ids as an array."""
        return np.frombuffer(b"".join(x for part in self.parts(text) for x in part), dtype="<u4")


class Decoder:
    """Ids to text in parts: bytes that end inside a character wait for the next part; what is no UTF-8 becomes U+FFFD."""

    def __init__(self, merges: Merges) -> None:
        self.table = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.state.decode(b"".join([self.table[i] for i in ids]), final)


def ranked(merges: Merges) -> Callable[[str], list[int] | array]:
    """Text encoded by the tiktoken library, where ids rise with the ranks of merges, as it needs. It gets a long text by pre-tokens."""
    made = [v & LOW for v in merges.pairs.values()]
    if made != sorted(set(made)):
        raise ValueError("the ids of merged tokens do not follow the ranks of their merges")
    import tiktoken

    special = set(merges.special.values())
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(merges.bytes_of) if b and i not in special}, special_tokens={})
    split = regex.compile(PATTERN)

    def encode(text: str) -> list[int] | array:
        if len(text) <= UNSPLIT:
            return own.encode_ordinary(text)
        return array("I", chain.from_iterable(own._encode_single_piece(m[0]) for m in split.finditer(text)))

    return encode


def ranked_chunks(merges: Merges) -> Callable[[list[str]], list[list[int] | array]]:
    """ranked() of each chunk."""
    encode = ranked(merges)
    return lambda chunks: list(map(encode, chunks))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file of that name is."""
    import public_tokenizers

    return public_tokenizers.path(name)
