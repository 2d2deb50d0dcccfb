"""Console output collected from containers: cleaning it and reading finding blocks out of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansieve.operators.findings import NO_URL
from plansieve.operators.ordered import CHUNK_ROWS, running
from plansieve.sources.lines import read_log_lines

# Openings of the banner lines that log aggregation puts around a container's output.
BANNERS = (
    "************************",
    "End of LogType:stdout",
    "LogAggregationType: ",
    "LogType:stdout",
    "LogLastModifiedTime",
    "LogLength:",
    "LogContents:",
)

# Marker lines around the parts of a finding.
BLOCK_STARTS = ("__BLOCKSTART__SQL", "__BLOCKSTART__URL")
SQL_END_MARK = "__BLOCKEND__SQL"
URL_END_MARK = "__BLOCKEND__URL"


def clean_output(lines: DataFrame) -> DataFrame:
    """Drop blank lines and aggregation banners from rows with a ``value`` column."""
    value = F.col("value")
    banner = F.lit(False)
    for opening in BANNERS:
        banner = banner | value.startswith(opening)
    # Blank means nothing but characters up to the space, tabs and carriage returns included.
    return lines.filter(value.rlike(r"[^\x00-\x20]") & ~banner)


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """(log_id, ord, value) of the cleaned lines of every file below ``path``; ``log_id`` is the file's path."""
    return clean_output(read_log_lines(spark, path, file_glob="*", log_id_pattern=r"^(.*)$", part_pattern=r"^()$"))


def parse_findings(lines: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(log_id, block_no, url, sql): one row per closed SQL block of each file.

    A block is the text between a start marker and the next end marker, and the end marker decides its
    kind. A SQL block belongs to the latest URL block before it. Text outside blocks, blocks of other
    kinds and empty blocks are ignored.
    """
    value = F.col("value")
    is_end = value.isin(SQL_END_MARK, URL_END_MARK)
    marked = running(
        lines.select("log_id", "ord", "value"),
        "log_id",
        last={"inside": F.when(value.isin(*BLOCK_STARTS), F.lit(1)).when(is_end, F.lit(0))},
        total={"ended": F.when(is_end, F.lit(1)).otherwise(F.lit(0)).cast("bigint")},
        chunk_rows=chunk_rows,
    )
    # Lines up to and including the n-th end marker form block n. What follows a file's last end marker is in no block, and may
    # be all the rest of a file whose container was killed: it goes before anything is gathered.
    block_no = F.col("ended") - F.when(is_end, F.lit(1)).otherwise(F.lit(0))
    content = ~is_end & ~value.isin(*BLOCK_STARTS) & (F.col("inside") == 1)
    n_blocks = lines.filter(is_end).groupBy("log_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    blocks = (
        marked.filter(is_end | content)
        .join(n_blocks, "log_id")
        .filter(block_no < F.col("n_blocks"))
        .groupBy("log_id", block_no.alias("block_no"))
        .agg(
            F.max(F.when(is_end, value)).alias("end_mark"),
            F.collect_list(F.when(content, F.struct("ord", "value"))).alias("text"),
        )
        .filter(F.col("end_mark").isNotNull() & (F.size("text") > 0))
        .select(
            "log_id",
            "block_no",
            "end_mark",
            F.array_join(F.transform(F.sort_array("text"), lambda line: line["value"]), "\n").alias("text"),
        )
    )
    with_url = running(
        blocks,
        "log_id",
        ord="block_no",
        last={"url": F.when(F.col("end_mark") == URL_END_MARK, F.col("text"))},
        chunk_rows=chunk_rows,
    )
    return with_url.filter(F.col("end_mark") == SQL_END_MARK).select(
        "log_id", "block_no", F.nullif("url", F.lit(NO_URL)).alias("url"), F.col("text").alias("sql")
    )
