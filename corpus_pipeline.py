"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

All stages but the last keep the columns of the documents. Null texts and texts without a letter have no language
and go in the first stage; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import decontaminate, language_id, ngram_join, packing, secret_scan
from pairloom.llm.tables import documents, stage

WORDS, PERCENT = 5, 80  # what near copies share; op4_ngram_join has its own

def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a recognised language stay."""
    return language_id.known_language(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies, by runs of five words and a similarity of 0.8, the one with the smallest id stays."""
    return ngram_join.one_of_each(docs, k=WORDS, percent=PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text, and the length follows."""
    return secret_scan.redact(docs, length="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("ngram_join", one_of_each),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

ORACLE_SQL = None  # languages are learned and tokens are no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
