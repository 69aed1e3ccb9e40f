"""A corpus pipeline over documents: quality rules, exact and near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anomalypool.llm import bpe, exact_dedup, near_text, packing, quality_rules, suffix_dedup
from anomalypool.llm.common import materialise, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned rules reject go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of least id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by a Jaccard similarity of 0.8 or more of five-word shingles the one of least id stays."""
    return near_text.one_of_each_near_group(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of long strings that start earlier, here or in a document of smaller id, go; every document stays."""
    return suffix_dedup.without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens at their places in sequences of at most 1024."""
    return packing.pack(docs, bpe.vocabulary_path())


STAGES = [
    ("quality rules", keep_quality), ("exact dedup", drop_exact_copies), ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeated_passages), ("best-fit packing", pack_sequences),
]

#: The rules are learned and the bins are planned, which SQL can't say; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next; what the last returns."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
