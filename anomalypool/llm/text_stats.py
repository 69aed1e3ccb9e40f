"""Counts over one whole text, and ratios made of them, for quality rules and the quality classifier."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

SPACE = b" \t\n\x0b\x0c\r"
LATER_BYTES = bytes(range(0x80, 0xC0))  # UTF-8 bytes that do not begin a character
SYMBOLS, UPPER, DIGITS, STOPS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b".,;:?"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_exclaim", "n_pipes", "n_stops")


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words in windows of size words that the text has twice or more, the first included."""
    windows = list(zip(*(words[i:] for i in range(size))))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    often = np.array([seen[w] > 1 for w in windows])
    covered = np.zeros(len(words), dtype=bool)
    for i in range(size):
        covered[i : i + len(windows)] |= often
    return int(covered.sum())


def text_counts(raw: bytes) -> tuple[int, ...]:
    """COUNTS of a text in UTF-8. Words are `[^\\x20\\x09-\\x0D]+`; n_dup_lines are \\n-split lines with a word that equal an earlier line."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    less = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words), len(raw.translate(None, SPACE + LATER_BYTES)), less(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), len(set(words)),
        less(UPPER), less(DIGITS), raw.count(b"!"), raw.count(b"|"), less(STOPS),
    )


def with_counts(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a struct of COUNTS (bigint each) of one text column, null as empty, under a name that df does not have."""
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

    def compute(texts: list[bytes]) -> list[pa.Array]:
        columns = list(zip(*map(text_counts, texts)))
        return [pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], names=list(COUNTS))]

    return append_columns(df, text, [name], [kind], compute)


#: Statistics by name: (numerator, denominator) of COUNTS; 0 where the denominator is 0.
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"), "distinct_ratio": ("n_distinct_words", "n_words"), "upper_ratio": ("n_upper", "word_chars"),
    "digit_ratio": ("n_digits", "word_chars"), "exclaim_ratio": ("n_exclaim", "n_words"), "pipe_ratio": ("n_pipes", "n_words"), "stop_ratio": ("n_stops", "n_words"),
}


def ratio(counts: str, name: str) -> Column:
    """A statistic as a Spark column of the struct column counts."""
    top, bottom = (F.col(counts)[c] for c in RATIOS[name])
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def ratio_matrix(counts: np.ndarray) -> np.ndarray:
    """The same statistics of rows of COUNTS, in the order of RATIOS."""
    at = {c: counts[:, i].astype(float) for i, c in enumerate(COUNTS)}
    return np.stack([np.divide(at[a], at[b], out=np.zeros(len(counts)), where=at[b] > 0) for a, b in RATIOS.values()], axis=1)


def labelled_counts(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str, text_col: str, usable: Column | None = None) -> DataFrame:
    """(id, label, counts) of at most bound labelled texts: those of least hash of the id, so that the choice is the same at any partitioning.

    Rows without id or label are left out; an id with several labels takes the least. The chosen ids, bound at most,
    are broadcast.
    """
    known = labels.select(F.col(id_col).alias("_lid"), F.col(label).cast("int").alias("_label")).filter("_lid IS NOT NULL AND _label IS NOT NULL")
    known = known.filter(usable) if usable is not None else known
    chosen = known.groupBy("_lid").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_lid"), "_lid").limit(bound)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_lid"))
    return with_counts(rows.select("_id", "_label", "_text"), "_text", "_counts").select("_id", "_label", "_counts")
