"""Token counts of sections: whole texts are encoded once, and tokens go to sections by their character spans."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, load_merges, ranked_chunks
from .common import byte_list, per_batch

RULES = ("first", "majority")


def attribute(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """For tokens that end at token_ends and sections that end at section_ends, both in order over the same bytes: the
    section of each token, and whether it crosses the end of a section.

    first: a token belongs to the section that holds its first byte. majority: to that with most of its bytes, the
    earlier at a tie.
    """
    starts = np.concatenate([[0], token_ends])[:-1].astype(np.int64)
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    crosses = first != last
    if rule == "majority":
        bounds = np.concatenate([[0], section_ends])
        for i in np.nonzero(crosses)[0]:
            at = np.arange(first[i], last[i] + 1)
            held = np.minimum(bounds[at + 1], token_ends[i]) - np.maximum(bounds[at], starts[i])
            first[i] = at[np.argmax(held)]
    return first, crosses


def section_token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "first") -> DataFrame:
    """id, section, start, n_chars, n_tokens, n_crossing: one row per line of each text, in which a line is a section with the \\n that ends it.

    start and n_chars are in code points. Tokens that cross from one section into another count once, in the section
    that the rule names; n_crossing says how many of a section's tokens do. The counts of a text add up to the
    tokens of the whole text. Null and empty texts have one empty section, number 0. Repeated ids give repeated rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def make():
        merges = load_merges(vocabulary)
        encoder = Encoder(merges, ranked_chunks(merges))
        width = np.array([len(b) for b in merges.bytes_of], dtype=np.int64)

        def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            row, section, start, chars, tokens, crossing = [], [], [], [], [], []
            for at, raw in enumerate(byte_list(batch.column(1))):
                raw = raw.decode("utf-8", "replace").encode()
                lines = raw.split(b"\n")
                lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
                ends = np.cumsum([len(x) for x in lines])
                n = [len(x.decode()) for x in lines]
                ids = encoder.ids(raw.decode())
                own, crosses = attribute(np.cumsum(width[ids]), ends, rule)
                row += [at] * len(lines)
                section += range(len(lines))
                start += np.concatenate([[0], np.cumsum(n)[:-1]]).tolist()
                chars += n
                tokens += np.bincount(own, minlength=len(lines)).tolist()
                crossing += np.bincount(own[crosses], minlength=len(lines)).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(section, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, chars, tokens, crossing))],
                names=[id_col, "section", "start", "n_chars", "n_tokens", "n_crossing"],
            )

        return step

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(per_batch(make), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, section int, start bigint, n_chars bigint, n_tokens bigint, n_crossing bigint")
