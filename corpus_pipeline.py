"""A training-data pipeline: language, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the last keep the columns of
documents. Null texts are carried as nulls until a stage's rule drops them: the language stage drops texts without a letter, so
null and empty ones. Repeated rows (equal in id and text) become one, of rows that share an id but not a text each is judged by
its own. Ties: of a class of near duplicates the least id stays, of equal ids the least text hash. Very long texts pass whole. Empty tables
give empty results. Columns beside those of documents are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import op03_pii_boosting, op04_ngram_jaccard, op07_piece_scan, op09_language_crf, op10_decontamination
from pointloom.llm.common import materialize, table

SURE = 0.4  # share of the likeliest language below which a document is rejected


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those in which no language has a fair share, go."""
    found = op09_language_crf.identify(docs, docs.columns, names=("_lang_pred", "_score"))
    return found.where((F.col("_lang_pred") != "und") & (F.col("_score") >= SURE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest id stays (documents without an id come last; of equal ids the least text hash). Rows equal in id and text are one document."""
    return op04_ngram_jaccard.one_of_each_class(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; of rows that share an id each is judged by its own text."""
    return op10_decontamination.without_items(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kind; n_chars follows."""
    out = op03_pii_boosting.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the text's token ids."""
    return op07_piece_scan.encode_documents(docs, ["doc_id", "source"], ids_too=True).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]
ORACLE_SQL = None  # fitted models and tokens are not expressible; tests/llm compares each stage with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
