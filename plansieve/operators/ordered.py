"""Running values along the lines of a log, without ever sorting a whole log in one task.

A plain window over a log would put the largest log into one task. Here every log is cut into chunks of
bounded size by its line order: chunks are summarised in parallel, only the summaries (one row per chunk)
are scanned per log, and the carried-in value then meets a window inside each chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 100_000


def running(
    rows: DataFrame,
    key: str,
    ord: str = "ord",
    last: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add running columns to ``rows``, in order of ``ord`` within ``key``.

    ``last`` columns hold the latest non-NULL value up to and including the row; ``total`` columns hold
    the running sum. ``ord`` must be numeric and distinct within the key, so a chunk holds at most
    ``chunk_rows`` rows.
    """
    last, total = last or {}, total or {}
    cut = rows.withColumn("_chunk", F.floor(F.col(ord) / F.lit(chunk_rows)))
    per_chunk = cut.groupBy(key, "_chunk").agg(
        *[F.max_by(v, F.when(v.isNotNull(), F.col(ord))).alias(f"_last_{n}") for n, v in last.items()],
        *[F.sum(v).alias(f"_total_{n}") for n, v in total.items()],
    )
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(
        key,
        "_chunk",
        *[F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_last_{n}") for n in last],
        *[F.sum(f"_total_{n}").over(before).alias(f"_total_{n}") for n in total],
    )
    inside = Window.partitionBy(key, "_chunk").orderBy(ord).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(carried, [key, "_chunk"], "left")
    for n, v in last.items():
        joined = joined.withColumn(
            n, F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(f"_last_{n}"))
        )
    for n, v in total.items():
        joined = joined.withColumn(
            n, F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.coalesce(F.col(f"_total_{n}"), F.lit(0))
        )
    return joined.drop("_chunk", *[f"_last_{n}" for n in last], *[f"_total_{n}" for n in total])
