"""Saving findings as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_findings(findings: DataFrame, path: str) -> None:
    """Write findings, repeats dropped, as parquet partitioned by detector."""
    # A map cannot be compared, so equal details are recognised by their sorted entries.
    keyed = findings.withColumn("_detail", F.to_json(F.array_sort(F.map_entries("detail"))))
    distinct = keyed.dropDuplicates(["detector", "log_id", "execution_id", "url", "sql", "_detail"]).drop("_detail")
    distinct.write.partitionBy("detector").mode("append").parquet(path)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
