"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import (
    op01_suffix_dedup,
    op02_backoff_scoring,
    op03_pii_boosting,
    op04_ngram_jaccard,
    op05_chroma_fingerprint,
    op06_toxicity_gru,
    op07_piece_scan,
    op08_histogram_sort,
    op09_language_crf,
    op10_decontamination,
    op11_fill_in_middle,
    op12_va_negatives,
    op13_secret_scan,
)
from pointloom.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op02_backoff_scoring.backoff_scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_pii_boosting.personal_data(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_ngram_jaccard.jaccard_classes(table(spark, sf_dir, "documents"))


def op5_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = op05_chroma_fingerprint.recordings(table(spark, sf_dir, "embeddings"))
    return op05_chroma_fingerprint.match_pairs(media, "vec_id", "audio").withColumnRenamed("id", "vec_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_toxicity_gru.toxicity_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_piece_scan.encode_documents(table(spark, sf_dir, "documents"), ["doc_id"])


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_histogram_sort.shard_documents(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_language_crf.language_of_documents(table(spark, sf_dir, "documents"))


def op10_decontamination_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_fill_in_middle_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_va_negatives.negatives_of_embeddings(table(spark, sf_dir, "embeddings"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_secret_scan.secrets_of_documents(table(spark, sf_dir, "documents"))


# op13 has no SQL, since checksums are not expressible; tests/llm compares it with Python's patterns.
# op3 has no SQL, since positions of matches are not expressible in one statement; tests/llm compares base spans with Python's patterns.
ORACLE_4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws] ELSE list_distinct([ws[i:i + 4] FOR i IN range(1, len(ws) - 3)]) END AS g FROM w
),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
),
e AS (
  SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * k >= 75 * (len(a.g) + len(b.g) - k)
),
links AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.a, links.y FROM reach JOIN links ON links.x = reach.b)
SELECT doc_id, len(g) AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM s
"""

QUERIES = {f.__name__.rstrip("_"): f for f in (op1_suffix_dedup, op2_lm_scoring, op3_pii, op4_ngram_jaccard, op5_chroma_fingerprints, op6_toxicity, op7_sentencepiece, op8_sharding, op9_language_id, op10_decontamination_, op11_fill_in_middle_, op12_hard_negatives, op13_secrets)}
ORACLES = {"op2_lm_scoring": op02_backoff_scoring.ORACLE, "op4_ngram_jaccard": ORACLE_4, "op10_decontamination": op10_decontamination.ORACLE, "op11_fill_in_middle": op11_fill_in_middle.ORACLE, "op12_hard_negatives": op12_va_negatives.ORACLE}
