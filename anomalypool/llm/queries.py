"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bpe_columns, chat_tree, exact_dedup, html_extract, packing, quality_model, quality_rules, simhash, suffix_dedup, token_counts
from .common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one, -7, that speaks in control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat_tree.conversation_digests(chat_tree.chat_packs(turns.unionByName(probe), bpe.vocabulary_path()), bpe.vocabulary_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels outside the held-out fourth."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(4))
    model = quality_model.fit(docs, labels, usable=remainder("_lid") != 2)
    scored = quality_model.score_texts(docs, model)
    return scored.select("doc_id", (remainder("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe.vocabulary_path())


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_token_counts(table(spark, sf_dir, "documents"), bpe.vocabulary_path())


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_columns.round_trip_digests(table(spark, sf_dir, "documents"), bpe.vocabulary_path())


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), digests=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_simhash, op3_html_extract, op4_quality_model, op5_packing, op6_token_counts, op7_bpe, op8_suffix_dedup, op9_quality_rules, op10_exact_dedup)}

ORACLE_SQL = {
    "op1_chat_format": r"""
        WITH said AS (SELECT '</s>[INST] ok [/INST]' AS s),
        turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', s FROM said UNION ALL SELECT -7, 1, 'assistant', s FROM said),
        sized AS (SELECT *, replace(text, '\', '\\') AS t, replace(replace(role, '\', '\\'), chr(10), '\n') AS r, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>' AS control FROM turns)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
          sum(length('<|im_start|>') + length(r) + len(regexp_extract_all(r, control)) + 1 + length(t) + len(regexp_extract_all(t, control)) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
    "op8_suffix_dedup": r"""
        WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
        starts AS (SELECT doc_id, t, unnest(range(1, octet_length(t) - 98)) AS i FROM b),
        again AS (SELECT doc_id, i FROM starts QUALIFY row_number() OVER (PARTITION BY t[i:i + 99] ORDER BY doc_id, i) > 1),
        marked AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM again),
        numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
        spans AS (SELECT doc_id, min(i) AS lo, max(i) + 99 AS hi FROM numbered GROUP BY doc_id, span),
        pieces AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM spans),
        cut AS (SELECT doc_id, sum(hi - lo + 1)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(hex(t[before + 1:lo - 1]), '' ORDER BY lo) || hex(any_value(t)[max(hi) + 1:]) AS kept FROM pieces JOIN b USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, octet_length(t) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN n_spans IS NULL THEN t ELSE unhex(kept) END) AS kept_sha256
        FROM b LEFT JOIN cut USING (doc_id)
    """,
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
}
