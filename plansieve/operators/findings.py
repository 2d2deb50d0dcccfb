"""Findings: the common shape of detector results, their de-duplication and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stands in a URL block for a finding of an unknown application, so that the block is not empty.
NO_URL = "(no url)"

FINDING_COLUMNS = ["detector", "log_id", "execution_id", "url", "sql", "detail"]


def detail_map(*columns: str) -> Column:
    """The named columns as a MAP<STRING, STRING>; NULL columns are left out."""
    if not columns:
        return F.create_map().cast("map<string,string>")
    entries = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def as_findings(rows: DataFrame, detector: str, details: list[str]) -> DataFrame:
    """Bring (log_id, execution_id, url, sql, details...) rows into the shape all detectors share."""
    return rows.select(
        F.lit(detector).alias("detector"),
        "log_id",
        F.col("execution_id").cast("bigint").alias("execution_id"),
        "url",
        "sql",
        detail_map(*details).alias("detail"),
    )


def dedup_messages(rows: DataFrame) -> DataFrame:
    """One row per exact message text and log."""
    return rows.dropDuplicates(["log_id", "message"])


def unique_by_sql(blocks: DataFrame) -> DataFrame:
    """(sql, url, occurrences): each SQL text once, with the URL of its last block in file order."""
    return blocks.groupBy("sql").agg(
        F.max_by("url", F.struct("log_id", "block_no")).alias("url"), F.count(F.lit(1)).alias("occurrences")
    )


def _block(kind: str, text: Column) -> Column:
    return F.concat_ws("\n", F.lit(f"__BLOCKSTART__{kind}"), text, F.lit(f"__BLOCKEND__{kind}"))


def finding_blocks(findings: DataFrame) -> DataFrame:
    """Findings as the marked text blocks that :func:`plansieve.sources.console.parse_findings` reads.

    Cost trees among the details follow as blocks of their own, which that parser passes over.
    """
    url = F.coalesce(F.nullif("url", F.lit("")), F.lit(NO_URL))
    detail = F.col("detail")
    costs = [F.when(detail[key].isNotNull(), _block(kind, detail[key])) for kind, key in (("PLANCOST", "plan_cost"), ("SMALLCHILD", "join_cost"))]
    text = F.concat_ws("\n", _block("URL", url), _block("SQL", F.coalesce("sql", F.lit(""))), *costs)
    return findings.select("log_id", "execution_id", text.alias("value"))
