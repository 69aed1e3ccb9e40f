"""Chat formatting by prefix trees: conversations that begin alike share their first turns, which are written once.

Conversations are sorted by the hashes of their turns, so that the order of rows is the depth-first order of the
prefix trees. A pack is a stretch of that order: a stream of tokens in which every shared turn stands once, in front of
all that follows it, with the position of each turn in its own conversation and the intervals of the stream that the
turn may attend to: its ancestors and itself. A turn's head, text and end are encoded apart, so that its tokens depend
on nothing before it and the loss mask begins and ends between tokens.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, load_merges, ranked_chunks

#: The template's marks, and the control strings that texts are kept from spelling.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
PACK_TOKENS = 1 << 18
PACK_LEAVES = 1 << 14
RECENT = 1 << 14  # chunks that an encoder remembers
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    """Backslashes doubled, and one put behind the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    """As escape(), with line breaks spelled \\n, as a role ends with its line."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)?", lambda m: {"\\": "\\", "n": "\n", None: ""}[m[1]], role)


def turn_pieces(role: str, text: str) -> tuple[str, str, str]:
    """A formatted turn: what stands before the escaped text, that text, and what ends the turn."""
    return f"{OPEN}{escape_role(role)}{MIDDLE}", escape(text), CLOSE


def format_turn(role: str, text: str) -> str:
    return "".join(turn_pieces(role, text))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a formatted conversation."""
    out = []
    for turn in formatted.split(OPEN)[1:]:
        role, _, rest = turn.partition(MIDDLE)
        out.append((unescape_role(role), unescape(rest[: -len(CLOSE)])))
    return out


PACK = """pack string, ids array<int>,
nodes array<struct<start bigint, length bigint, position bigint, parent int, loss_start bigint, loss_end bigint, intervals array<struct<lo bigint, hi bigint>>>>,
leaves array<struct<conv_id {id}, node int>>"""


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Encoder:
    """One a worker process, whatever the number of its tasks."""
    merges = load_merges(vocabulary)
    return Encoder(merges, ranked_chunks(merges), memory=RECENT)


class _Pack:
    """The open pack: a column for each field of its nodes, whose intervals stand one behind the other."""

    FIELDS = ("start", "length", "position", "parent", "loss_start", "loss_end")

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.ids = array("i")
        self.fields = {f: array("q") for f in self.FIELDS}
        self.lows, self.highs, self.ends = array("q"), array("q"), array("i", [0])  # ends: of the intervals of each node
        self.convs: list = []
        self.at = array("i")
        self.path: list[tuple[tuple[str, str], int]] = []  # the turns of the last conversation, and their nodes

    def add(self, conv_id, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for turn in turns[shared:]:
            parent, position, seen = -1, 0, []
            if self.path:
                parent = self.path[-1][1]
                position = self.fields["position"][parent] + self.fields["length"][parent]
                own = slice(self.ends[parent], self.ends[parent + 1])
                seen = [*zip(self.lows[own], self.highs[own])]
            start = len(self.ids)
            bounds = []
            for piece in turn_pieces(*turn):
                self.ids.frombytes(self.encoder.ids(piece).astype("<i4").tobytes())
                bounds.append(len(self.ids))
            head, body, end = bounds
            if seen and seen[-1][1] == start:
                seen[-1] = (seen[-1][0], end)
            else:
                seen.append((start, end))
            loss = (head, body) if turn[0] == "assistant" else (start, start)
            for f, v in zip(self.FIELDS, (start, end - start, position, parent, *loss)):
                self.fields[f].append(v)
            self.lows.extend(lo for lo, _ in seen)
            self.highs.extend(hi for _, hi in seen)
            self.ends.append(len(self.lows))
            self.path.append((turn, len(self.ends) - 2))
        self.convs.append(conv_id)
        self.at.append(self.path[-1][1] if self.path else -1)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        """One row, as columns."""
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        of = lambda values, kind: pa.array(np.array(values), kind)
        name = hashlib.sha256(f"{self.convs[0]}|{len(self.convs)}|".encode() + self.ids.tobytes()).hexdigest()[:32]
        intervals = pa.ListArray.from_arrays(of(self.ends, pa.int32()), pa.StructArray.from_arrays([of(self.lows, pa.int64()), of(self.highs, pa.int64())], ["lo", "hi"]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        nodes = pa.StructArray.from_arrays([*(of(self.fields[f], k) for f, k in zip(self.FIELDS, kinds)), intervals], [*self.FIELDS, "intervals"])
        leaves = pa.StructArray.from_arrays([pa.array(self.convs, schema.field("leaves").type.value_type.field("conv_id").type), of(self.at, pa.int32())], ["conv_id", "node"])
        return pa.RecordBatch.from_arrays([pa.array([name]), whole(of(self.ids, pa.int32())), whole(nodes), whole(leaves)], schema=schema)


def chat_packs(turns: DataFrame, vocabulary: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", pack_tokens: int = PACK_TOKENS, pack_leaves: int = PACK_LEAVES) -> DataFrame:
    """Packs of formatted conversations, from one row per turn: pack, ids, nodes, leaves.

    ids are the tokens of the stream. nodes are its turns in its order: start and length in the stream (tokens),
    position of their first token in their conversation, parent (number of a node, -1 at the root), the part of the stream that a
    loss counts (loss_start, loss_end), and intervals: the ancestors and the node itself, which is all it attends to.
    leaves says at which node each conversation ends; those with the same turns end at the same.

    A pack ends when the first turn changes after pack_tokens, or where a partition of the sorted conversations ends,
    or at 4 * pack_tokens or pack_leaves conversations whatever the turns: then the next pack begins with the shared
    turns again. So a first turn that very many conversations share is spread over many tasks, and a row stays bounded
    where very many conversations are equal. Null roles and texts count as empty; turns are in
    order of turn_col, null first, then of role and text; all rows of a conversation make one, the repeated ones too. Null ids make
    one conversation with a null id. No rows give no packs.
    """
    rows = turns.select(F.col(conv_col).alias("_c"), F.struct(F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x")).alias("_t"))
    whole = rows.groupBy("_c").agg(F.array_sort(F.collect_list("_t"), lambda a, b: _before(a, b)).alias("_turns"))
    # eight hash characters a turn: conversations that share turns share the beginning, in the order of the tree
    path = F.concat_ws("", F.transform("_turns", lambda t: F.substring(F.sha2(F.concat_ws("\n", t["r"], t["x"]), 256), 1, 8)))
    order = whole.select("_c", F.transform("_turns", lambda t: F.struct(t["r"].alias("r"), t["x"].alias("x"))).alias("_turns"), path.alias("_path"))
    order = order.repartitionByRange("_path", "_c").sortWithinPartitions("_path", "_c")
    schema = PACK.format(id=rows.schema["_c"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        pack = _Pack(encoder)
        for batch in batches:
            for conv_id, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spoken = [(t["r"], t["x"]) for t in own]
                apart = not pack.path or not spoken or pack.path[0][0] != spoken[0]
                size = len(pack.ids)
                if pack.convs and (size >= pack_tokens and apart or size >= 4 * pack_tokens or len(pack.convs) >= pack_leaves):
                    yield pack.batch(arrow)
                    pack = _Pack(encoder)
                pack.add(conv_id, spoken)
        if pack.convs:
            yield pack.batch(arrow)

    id_type = _arrow_type(rows.schema["_c"].dataType)
    interval = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
    node = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("position", pa.int64()), ("parent", pa.int32()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("intervals", pa.list_(interval))])
    arrow = pa.schema([("pack", pa.string()), ("ids", pa.list_(pa.int32())), ("nodes", pa.list_(node)), ("leaves", pa.list_(pa.struct([("conv_id", id_type), ("node", pa.int32())])))])
    return order.select("_c", "_turns").mapInArrow(run, schema)


def _before(a, b):
    less = F.lit(0)
    for f in ("x", "r", "t"):
        less = F.when(a[f].eqNullSafe(b[f]), less).when(a[f].isNull(), -1).when(b[f].isNull(), 1).when(a[f] < b[f], -1).otherwise(1)
    return less


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def conversation_digests(packs: DataFrame, vocabulary: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: every conversation decoded and read back from the packs.

    A conversation is what its last node attends to. turns_sha256 is of role, \\n, text, \\n of every turn; the loss
    digest is of the unescaped text under the loss mask.
    """
    kind = packs.schema["leaves"].dataType.elementType["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load_merges(vocabulary).bytes_of
        size_of = np.array(list(map(len, table)))

        def digests(stream: bytes, spans: list[tuple[int, int]], losses: list[tuple[int, int]]) -> tuple:
            own = b"".join(stream[lo:hi] for lo, hi in spans).decode()
            masked = "".join(unescape(stream[lo:hi].decode()) for lo, hi in losses)
            turns = read_turns(own)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(own)

        for batch in batches:
            for ids, nodes, leaves in zip(*(batch.column(c) for c in ("ids", "nodes", "leaves"))):
                ids = ids.values.to_numpy()
                stream = b"".join([table[i] for i in ids.tolist()])
                byte = np.concatenate([[0], np.cumsum(size_of[ids])])  # where each token begins
                of = dict(zip((f.name for f in nodes.values.type), nodes.values.flatten()))
                parent, losses = of["parent"].to_numpy().tolist(), [*zip(*(byte[of[f].to_numpy()].tolist() for f in ("loss_start", "loss_end")))]
                ends = of["intervals"].offsets.to_numpy()
                own = of["intervals"].values.slice(ends[0], ends[-1] - ends[0]).flatten()  # of this pack, not of all the batch
                ends, (lows, highs) = (ends - ends[0]).tolist(), (byte[x.to_numpy()].tolist() for x in own)
                convs, at = leaves.values.flatten()
                known = {-1: digests(b"", [], [])}
                for node in at.to_numpy().tolist():
                    if node in known:
                        continue
                    path, up = [], node
                    while up >= 0:
                        path.append(losses[up])
                        up = parent[up]
                    own = slice(ends[node], ends[node + 1])
                    known[node] = digests(stream, [*zip(lows[own], highs[own])], path[::-1])
                columns = zip(*(known[node] for node in at.to_numpy().tolist()))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([convs.cast(id_type), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    id_type = _arrow_type(kind)
    return packs.select("ids", "nodes", "leaves").mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
