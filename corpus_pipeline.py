"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, packing.

Each stage works on all that the one before kept; all but the last return the columns of ``documents``. Between stages the
rows are written to the shared scratch folder and read again, so a lost executor costs no earlier stage.

Defined results: a null or empty text has no words and goes with the quality rules; a row without doc_id is nobody's near-duplicate and
takes part in the other stages like any other; different texts of one doc_id are different documents; rows equal in doc_id and text
leave one; columns besides doc_id, text and n_chars are carried along, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansieve.llm import decontaminate, neardup, packing, quality, substrings
from plansieve.llm.common import table
from plansieve.operators.narrow import stash

# SQL has no tokenizer, and the near-duplicate stage would be all pairs: tested against brute force instead.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality.apply_policy(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingles of 5 words, similarity 0.8 or more) the smallest doc_id stays."""
    return neardup.keep_one_of_each(docs, neardup.Similarity())


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 13 words that a document with a smaller doc_id has are cut out; n_chars follows the text."""
    left = substrings.remove_repeats(docs)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in pieces, each with its sequence and offset there."""
    return packing.pack(docs, packing.standard_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
