"""Corpus pipeline: quality rules, near-duplicates, personal data, packing, each stage on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import minhash, packing, pii, quality
from marketframe.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  Null and empty texts fail; repeated rows are judged alike, each by itself; an empty table
    gives no rows."""
    return quality.keep(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar by 0.8 or more: the one with the smallest id.

    Null ids come last; of identical rows one stays; texts without words all stay; an empty table gives no rows.
    """
    return minhash.one_of_each(docs.select(COLUMNS), words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that reveal it taken out of their texts; n_chars follows.

    Null texts stay null, as does their n_chars; ids may be null or repeated; repeated rows are cleaned alike, each by itself; an empty
    table gives no rows.
    """
    return pii.sanitise(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and place.  A null or empty text is its end id alone; repeated rows are packed
    each; an empty table gives no rows."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 0, 2048), 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]
#: Sketches, hashed n-grams and tokenizers are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is a table in the shared folder before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
