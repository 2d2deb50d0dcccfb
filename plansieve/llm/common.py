"""Column helpers shared by the corpus operators.

Texts reach the operators as they are: a null text is an empty one, whole texts are read, and every input
column besides the ones an operator names is ignored (or carried inside one struct, so names cannot clash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# What separates words; both are fixed values of the word definitions.
SPACES = "[\\x20\\x09-\\x0D]+"
NOT_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
NOT_ALNUM_ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would also change other letters)."""
    return F.translate(text, UPPER, UPPER.lower())


def split_words(text: Column, separators: str) -> Column:
    """The words between ``separators``, none of them empty; none for a null text."""
    return F.array_remove(F.split(text_of(text), separators), "")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Columns equal for repeated rows only: rows of one id but other texts stay apart.

    Results that depend on the text alone can be computed once per key and counted out to its rows.
    """
    return [doc_id.alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash")]


def numbered(rows: DataFrame, group: str, order: list[str], bucket: str) -> DataFrame:
    """``slot``: gapless from 0 within each group, in the order of (bucket, order).

    Only a bucket of a group is sorted by one task; where it begins is the running sum of the sizes of the buckets before it,
    a table of at most groups x buckets rows, which the caller keeps small by the number of buckets.
    """
    sizes = rows.groupBy(group, bucket).agg(F.count("*").alias("n_rows"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, bucket, F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first_slot"))
    within = Window.partitionBy(group, bucket).orderBy(*order)
    ranked = rows.withColumn("nth", F.row_number().over(within))
    return (
        ranked.join(F.broadcast(starts), [group, bucket])
        .withColumn("slot", F.col("first_slot") + F.col("nth") - 1)
        .drop("first_slot", "nth", bucket)
    )
