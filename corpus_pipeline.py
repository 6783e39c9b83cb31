"""Corpus pipeline: language ID, exact dedup, near-duplicate removal, decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; all but the last return the
columns of ``documents``. Null ids and repeated rows are rows like any others, extra columns go along, an empty table
gives an empty one, and very long texts are read whole; what a stage does with null and empty texts is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbitfold.llm import decontaminate, exact_dedup, jaccard, language, pieces
from orbitfold.llm.common import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay: null and empty text, text without letters, or without any likely language, goes."""
    return language.drop_rejected(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest stays, then the smallest id; null equals empty."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; texts without words are no copies."""
    return jaccard.drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go; texts without words stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, decoded_sha256 of every document that is left; null text is empty."""
    return pieces.round_trip(docs, keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("sentence_pieces", sentence_pieces),
]

#: SQL cannot express the classifier and the tokenizer; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
