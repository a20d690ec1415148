"""The registered training-data queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelattice.llm import decontaminate, exact_dedup, html_extract, licenses, near_dedup, ngram_lm, oracles, packing, pii, quality, sharding


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a Kneser-Ney model of nine tenths of them."""
    return ngram_lm.train_and_score(_table(spark, sf_dir, "documents"), folds=10, order=3)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from four fifths of the labels."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "quality", 0.3)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled uniformly into 24 shards of equal row counts."""
    text = F.coalesce("text", F.lit(""))
    return sharding.shuffle_into_shards(_table(spark, sf_dir, "documents"), 24, seed=20240607).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving document of each group of equal texts, for every document."""
    return exact_dedup.deduplicate(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.digest(pii.find_spans(_table(spark, sf_dir, "documents")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under a five-word shingle similarity of 0.75."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return licenses.scan(_table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_quality, op3_sharding, op4_exact_dedup, op5_pii, op6_decontamination, op7_html_extraction, op8_packing, op9_near_duplicates, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
