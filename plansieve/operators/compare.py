"""Comparing plans and run times of the same queries under two settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plansieve.functions.text import normalize_ids, without_literals

BUCKET_MS = 1024


def median_runs(runs: DataFrame) -> DataFrame:
    """(query, variant, n_runs, elapsed_ms, plan): the middle run of each query and variant.

    Runs are ordered by (elapsed_ms, plan) and the one at index ``n_runs div 2`` is taken. The rank is
    found from counts, coarse buckets first, so no group of runs is ever gathered or sorted in one place
    and plan texts travel only for runs that tie on the chosen time.
    """
    key = ["query", "variant"]
    by_time = (
        runs.groupBy(*key, "elapsed_ms").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.floor(F.col("elapsed_ms") / BUCKET_MS))
    )
    buckets = by_time.groupBy(*key, "bucket").agg(F.sum("n").alias("n"))
    ordered = Window.partitionBy(*key).orderBy("bucket")
    ranked = buckets.select(
        *key,
        "bucket",
        "n",
        F.sum("n").over(ordered).alias("upto"),
        F.sum("n").over(Window.partitionBy(*key)).alias("n_runs"),
    )
    middle = F.expr("n_runs DIV 2")
    target = ranked.filter((F.col("upto") > middle) & (F.col("upto") - F.col("n") <= middle)).select(
        *key, "bucket", "n_runs", (middle - (F.col("upto") - F.col("n"))).alias("rank")
    )
    inside = Window.partitionBy(*key).orderBy("elapsed_ms")
    chosen = (
        by_time.join(target, [*key, "bucket"])
        .withColumn("upto", F.sum("n").over(inside))
        .filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        .select(*key, "elapsed_ms", "n_runs", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"))
    )
    ties = (
        runs.join(chosen, [*key, "elapsed_ms"])
        .groupBy(*key, "elapsed_ms", "n_runs", "rank", "plan")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("plan")))
    )
    return ties.filter(
        (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank"))
    ).select(*key, "n_runs", "elapsed_ms", "plan")


def plan_changes(runs: DataFrame, variant_a: str, variant_b: str) -> DataFrame:
    """(query, changed): whether the latest plans under two settings differ beyond their expression ids.

    Both plans meet in one aggregate per query; ids are renumbered only for the plans that are compared.
    """
    def latest(variant: str):
        return F.max_by("plan", F.when(F.col("variant") == variant, F.col("run_no")))

    plans = runs.groupBy("query").agg(latest(variant_a).alias("plan_a"), latest(variant_b).alias("plan_b"))
    return plans.filter(F.col("plan_a").isNotNull() & F.col("plan_b").isNotNull()).select(
        "query", (normalize_ids(F.col("plan_a")) != normalize_ids(F.col("plan_b"))).alias("changed")
    )


def comparison(runs: DataFrame, variant_a: str, variant_b: str) -> DataFrame:
    """(query, elapsed_a, elapsed_b, changed): median time under both settings, and whether the plan changed."""
    medians = (
        median_runs(runs.filter(F.col("variant").isin(variant_a, variant_b)))
        .groupBy("query")
        .agg(
            F.max(F.when(F.col("variant") == variant_a, F.col("elapsed_ms"))).alias("elapsed_a"),
            F.max(F.when(F.col("variant") == variant_b, F.col("elapsed_ms"))).alias("elapsed_b"),
        )
    )
    return medians.join(plan_changes(runs, variant_a, variant_b), "query").select(
        "query", "elapsed_a", "elapsed_b", "changed"
    )


def runs_from_executions(executions: DataFrame, plans: DataFrame) -> DataFrame:
    """Runs found in logs: executions described as ``name-i-reorder`` or ``name-i-noreorder``.

    ``plans`` gives (log_id, execution_id, plan) texts.
    """
    pattern = r"^(.*)-(\d+)-(reorder|noreorder)$"
    return (
        executions.filter(F.col("sql").rlike(pattern) & F.col("duration_ms").isNotNull())
        .join(plans, ["log_id", "execution_id"])
        .select(
            F.regexp_extract("sql", pattern, 1).alias("query"),
            F.regexp_extract("sql", pattern, 3).alias("variant"),
            F.regexp_extract("sql", pattern, 2).cast("bigint").alias("run_no"),
            F.col("duration_ms").alias("elapsed_ms"),
            "plan",
        )
    )


def similar_queries(executions: DataFrame) -> DataFrame:
    """(fingerprint, text, n, total_ms, example): SQL texts that are the same apart from literals."""
    return (
        executions.select("sql", "duration_ms", without_literals(F.col("sql")).alias("text"))
        .withColumn("fingerprint", F.md5("text"))
        .groupBy("fingerprint")
        .agg(
            F.min("text").alias("text"),
            F.count(F.lit(1)).alias("n"),
            F.sum("duration_ms").alias("total_ms"),
            F.min("sql").alias("example"),
        )
    )
