"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, skew_safe_lookup, text_or_empty, without

PREFIX_CHARS = 64
#: Bits of the hashed set of surviving groups: one megabyte to broadcast, at any size of input.
SET_BITS = 1 << 23
_WORD_BITS = 32768  # what bitmap_construct_agg holds in one row


def normalised(text: Column) -> Column:
    """Each run of [\\x20\\x09-\\x0D] as one space. The other five are single characters to replace; then only runs need the pattern."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.regexp_replace(text, " {2,}", " ")


def _survivors(groups: DataFrame, key: Column) -> DataFrame:
    """The keys of groups as a hashed set of SET_BITS bits, in rows of 4 KB: (bucket, bits)."""
    place = F.pmod(key, F.lit(SET_BITS))
    return groups.groupBy((place / _WORD_BITS).cast("int").alias("_bucket")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(_WORD_BITS))).alias("_bits"))


def _in_set(df: DataFrame, keys: DataFrame, key: Column, flag: str) -> DataFrame:
    """df with flag: whether the set has the key. Others may be in it by chance, which costs work and changes nothing."""
    place = F.pmod(key, F.lit(SET_BITS))
    slot = F.pmod(place, F.lit(_WORD_BITS))
    at = df.withColumn("_place", (place / _WORD_BITS).cast("int")).withColumn("_slot", slot.cast("int"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_slot") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, F.pmod(F.col("_slot"), F.lit(8))) == 1
    return at.join(F.broadcast(keys), F.col("_place") == F.col("_bucket"), "left").withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_place", "_slot", "_bucket", "_bits")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Classes of equal texts; equal means identical after each run of [\\x20\\x09-\\x0D] became one space.

    Returns id, keep_id, group_size, kept, full_hash, one row per row of docs.

    1. one narrow scan leaves (id, length, prefix hash); lengths that occur once are done;
    2. of the others, pairs (length, prefix hash) that occur once are done;
    3. only texts of the remaining groups are read in full and hashed with SHA-256. Which groups remain is told to
       that scan by a hashed set of fixed size, so no text is shuffled.

    Null texts count as empty. Of equal texts the smallest id stays; all rows with that very id count as it (a
    repeated row is not told from itself). A null id never becomes keep_id where its group has another id. Empty input gives
    no rows. Columns other than the two are not looked at. full_hash is null for rows that steps 1 and 2 settled.
    digests adds text_sha256, the hash of every text, which takes part in nothing: it makes the third scan read all.
    """
    texts = docs.select(F.col(id_col).alias("_id"), normalised(text_or_empty(text_col)).alias("_text"))
    length, prefix = F.octet_length("_text").cast("long"), F.xxhash64(F.substring("_text", 1, PREFIX_CHARS))
    narrow = materialise(texts.select("_id", length.alias("_length"), prefix.alias("_prefix")), "exact-narrow")

    lengths = narrow.groupBy("_length").count().filter("count > 1")
    by_length = _in_set(narrow, _survivors(lengths, F.xxhash64("_length")), F.xxhash64("_length"), "_alike").filter("_alike")
    both = F.xxhash64("_length", "_prefix")
    pairs = by_length.groupBy("_length", "_prefix").count().filter("count > 1")
    keys = materialise(_survivors(pairs, both), "exact-set")

    candidates = _in_set(texts.withColumns({"_length": length, "_prefix": prefix}), keys, both, "_alike")
    full = F.sha2(F.col("_text").cast("binary"), 256)
    digest = [full.alias("_digest")] if digests else []
    hashed = materialise(candidates.select("_id", F.when(F.col("_alike"), full).alias("_hash"), *digest), "exact-hash")

    groups = hashed.filter(F.col("_hash").isNotNull()).groupBy("_hash").agg(F.min("_id").alias("_keep"), F.count("*").alias("_size")).filter("_size > 1")
    settled = F.coalesce("_hash", F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string")))
    found = skew_safe_lookup(hashed.withColumn("_key", settled), "_key", groups, "_hash", "_size")
    keep = F.coalesce("_keep", "_id")
    full = F.when(~F.col("_key").startswith("#"), F.col("_key"))
    size = F.coalesce("_size", F.lit(1)).cast("long")
    return found.select(F.col("_id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("_id")).alias("kept"), full.alias("full_hash"), *([F.col("_digest").alias("text_sha256")] if digests else []))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates does not keep; all columns stay. Rows with a null id stay."""
    return without(docs, id_col, exact_duplicates(docs, id_col, text_col).filter(~F.col("kept")).select(id_col))
