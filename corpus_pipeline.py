"""The corpus pipeline: quality, exact dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns the rows it keeps with the columns of documents; the last one
returns the packed pieces. ``run`` writes and rereads each stage's rows.

Rows are told apart by their place, so rows without an id and rows that repeat
one are judged by their own texts. A null text counts as empty; all empty
texts are copies of each other, of which the row with the largest id stays,
and they have neither near-duplicates nor leaks. Extra columns are carried
along whatever their names; an empty table gives no rows. Only the leak filter
works by id: a row without one is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavelattice.llm import decontaminate, exact_dedup, near_dedup, packing, quality, store
from wavelattice.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; without labels all have a score of a half and stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id, a null one ranking lowest."""
    return exact_dedup.keep_distinct(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, a null one ranking last."""
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, and rows without an id."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# A fitted network and a genetic algorithm have no SQL form; the tests follow the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
