"""What a log says about its application, its SQL executions and its metrics.

Every table here is a keyed aggregate over events, so values are the final ones of the log, and the work
is combined on the map side: a log that holds a third of all events still shuffles one row per key and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansieve.operators.narrow import are_few, keep_needed, never_broadcast, stash
from plansieve.operators.ordered import CHUNK_ROWS, running
from plansieve.sources.decode import EventTables

UNKNOWN_METRIC = -1


def applications(tables: EventTables) -> DataFrame:
    """(log_id, app_id, attempt_id, app_name, start_ms): the last start event that names an application.

    A missing attempt is ``''``. A log whose start events carry no id keeps a row with NULLs.
    """
    return last_applications(tables.of("app"))


def last_applications(starts: DataFrame) -> DataFrame:
    """The applications among start events already at hand."""
    starts = starts.select(
        "log_id",
        F.when(F.col("App ID").isNotNull(), F.col("ord")).alias("named_at"),
        F.col("App ID").alias("app_id"),
        F.coalesce(F.col("App Attempt ID"), F.lit("")).alias("attempt_id"),
        F.col("App Name").alias("app_name"),
        F.col("Timestamp").alias("start_ms"),
    )
    fields = ["app_id", "attempt_id", "app_name", "start_ms"]
    return starts.groupBy("log_id").agg(*[F.max_by(f, "named_at").alias(f) for f in fields])


def query_id_links(tables: EventTables) -> DataFrame:
    """(log_id, execution_id, ord, query_id) of jobs that name both their execution and their group."""
    properties = F.col("Properties")
    return (
        tables.of("job")
        .select(
            "log_id",
            properties["spark.sql.execution.id"].try_cast("bigint").alias("execution_id"),
            "ord",
            properties["spark.jobGroup.id"].alias("query_id"),
        )
        .filter(F.col("execution_id").isNotNull() & F.col("query_id").isNotNull())
    )


def sql_executions(tables: EventTables, needed: DataFrame | None = None, query_ids: bool = True) -> DataFrame:
    """(log_id, execution_id, query_id, sql, start_ms, end_ms, duration_ms), one row per started execution.

    ``needed`` may name the (log_id, execution_id) keys wanted; other executions are then left out. Without ``query_ids`` jobs are not
    looked at, and that column is NULL.

    The last start wins and forgets what came before it: an end or a job counts only when it follows that
    start in line order. Because the last end (job) is after the last start whenever any is, one scan and
    one aggregate over the three event types are enough; nothing is joined.
    """
    properties, is_job = (F.col("Properties"), F.col("kind") == "job") if query_ids else (None, F.lit(False))
    group = F.when(is_job, properties["spark.jobGroup.id"]) if query_ids else F.when(is_job, None)
    execution = F.when(is_job, properties["spark.sql.execution.id"].try_cast("bigint")) if query_ids else F.when(is_job, None)
    events = (
        tables.of("sql_start", "sql_end", *(["job"] if query_ids else []))
        .select(
            "log_id",
            "ord",
            "kind",
            execution.otherwise(F.col("executionId")).alias("execution_id"),
            F.col("time").alias("ms"),
            group.otherwise(F.col("description")).alias("text"),
        )
        .filter(F.col("execution_id").isNotNull() & (~is_job | F.col("text").isNotNull()))
    )

    # A semi-join is not moved through the filter on the aggregate: few keys are asked for below both.
    few = needed is not None and are_few(needed)
    if few:
        events = keep_needed(events, needed, few)

    def at(what: str) -> Column:
        return F.when(F.col("kind") == what, F.col("ord"))

    last = (
        events.groupBy("log_id", "execution_id")
        .agg(
            F.max(at("sql_start")).alias("started"),
            F.max_by("ms", at("sql_start")).alias("start_ms"),
            F.max_by("text", at("sql_start")).alias("sql"),
            F.max(at("sql_end")).alias("ended"),
            F.max_by("ms", at("sql_end")).alias("end_ms"),
            F.max(at("job")).alias("linked"),
            F.max_by("text", at("job")).alias("query_id"),
        )
        .filter(F.col("started").isNotNull())
    )
    end_ms = F.when(F.col("ended") > F.col("started"), F.col("end_ms"))
    return (last if few else keep_needed(last, needed, few)).select(
        "log_id",
        "execution_id",
        F.when(F.col("linked") > F.col("started"), F.col("query_id")).alias("query_id"),
        "sql",
        "start_ms",
        end_ms.alias("end_ms"),
        (end_ms - F.col("start_ms")).alias("duration_ms"),
    )


def _last_per_id(pairs: Column, id_of=lambda p: p["id"]) -> Column:
    """Keep, of (id, value) pairs repeating an id within one line, the last. Repeats are rare: test first."""
    ids = F.transform(pairs, id_of)
    last_only = F.filter(
        pairs,
        lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: id_of(later) == id_of(p)),
    )
    return F.when(F.size(F.array_distinct(ids)) == F.size(ids), pairs).otherwise(last_only)


def _explode_pairs(events: DataFrame) -> DataFrame:
    return events.select("log_id", "ord", F.inline(_last_per_id(F.col("pairs")))).select(
        "log_id", F.col("id").alias("accumulator_id"), "value", "ord"
    )


def _driver_pairs() -> Column:
    return F.transform(
        "accumUpdates",
        lambda u: F.struct(F.get(u, F.lit(0)).alias("id"), F.get(u, F.lit(1)).alias("value")),
    )


def _metric_number(text: Column) -> Column:
    """Whole-number text as BIGINT, any other text as 0. Blanks around a number make it text."""
    return F.coalesce(F.when(F.trim(text) == text, text).try_cast("bigint"), F.lit(0))


def _stage_pairs() -> Column:
    with_value = F.filter(F.col("Stage Info.Accumulables"), lambda a: a["Value"].isNotNull())
    return F.transform(
        with_value, lambda a: F.struct(a["ID"].alias("id"), _metric_number(a["Value"]).alias("value"))
    )


def driver_metric_updates(tables: EventTables) -> DataFrame:
    """(log_id, accumulator_id, value, ord) of metrics the driver posted."""
    listed = _last_per_id(F.col("accumUpdates"), lambda u: F.get(u, F.lit(0)))
    return tables.of("driver").select("log_id", "ord", F.explode(listed).alias("u")).select(
        "log_id", F.get("u", F.lit(0)).alias("accumulator_id"), F.get("u", F.lit(1)).alias("value"), "ord"
    )


def stage_metric_updates(tables: EventTables) -> DataFrame:
    """(log_id, accumulator_id, value, ord) of metrics in completed stages; entries without a value are skipped."""
    listed = F.col("Stage Info.Accumulables")
    with_value = F.filter(listed, lambda a: a["Value"].isNotNull())
    # Where no id repeats, the list is unfolded as it is, which needs no copy of it.
    no_repeats = F.size(F.array_distinct(listed["ID"])) == F.size(listed)
    unfolded = F.explode(F.when(no_repeats, listed).otherwise(_last_per_id(with_value, lambda a: a["ID"]))).alias("a")
    found = tables.of("stage").select("log_id", "ord", unfolded).filter(F.col("a.Value").isNotNull())
    return found.select("log_id", F.col("a.ID").alias("accumulator_id"), _metric_number(F.col("a.Value")).alias("value"), "ord")


def metrics(tables: EventTables, needed: DataFrame | None = None) -> DataFrame:
    """(log_id, accumulator_id, value): the last value written by a stage or by the driver.

    ``needed`` may name the (log_id, accumulator_id) keys wanted; other metrics are then left out.
    """
    if tables.has_saved("stage", "driver"):
        # Each kind is a folder of its own: two scans read no more than one, and know what their rows hold.
        updates = stage_metric_updates(tables).unionByName(driver_metric_updates(tables))
    else:
        pairs = F.when(F.col("kind") == "stage", _stage_pairs()).otherwise(_driver_pairs())
        updates = _explode_pairs(tables.of("stage", "driver").select("log_id", "ord", pairs.alias("pairs")))
    return keep_needed(updates.groupBy("log_id", "accumulator_id").agg(F.max_by("value", "ord").alias("value")), needed)


def lookup_metric(rows: DataFrame, id_column: str, metric_values: DataFrame, out: str) -> DataFrame:
    """Add ``out``: the final value of the metric ``id_column`` names.

    It is -1 for a metric never written and NULL where the row names no metric. ``rows`` needs ``log_id``,
    ``ord`` and ``node_no``. Rows without an id can match nothing, so they join under negative stand-in
    keys drawn from their own place, which keeps them from meeting in one task.
    """
    stand_in = -F.pmod(F.xxhash64("ord", "node_no"), F.lit(1 << 62)) - 2
    values = metric_values.select("log_id", F.col("accumulator_id").alias("_metric_id"), F.col("value").alias("_value"))
    return (
        rows.withColumn("_metric_id", F.coalesce(F.col(id_column), stand_in))
        .join(never_broadcast(values), ["log_id", "_metric_id"], "left")
        .withColumn(
            out, F.when(F.col(id_column).isNotNull(), F.coalesce(F.col("_value"), F.lit(UNKNOWN_METRIC)))
        )
        .drop("_metric_id", "_value")
    )


def execution_marks(tables: EventTables) -> DataFrame:
    """(log_id, ord, mark): the id a start makes current, or NULL-standing -1 where an end clears it."""
    mark = F.when(F.col("kind") == "sql_start", F.col("executionId")).otherwise(F.lit(-1))
    return tables.of("sql_start", "sql_end").select("log_id", "ord", mark.alias("mark"))


def attribute_to_execution(events: DataFrame, tables: EventTables, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``current_execution_id`` to (log_id, ord, ...) events that carry no execution id of their own.

    It is the execution started last before the event, NULL before any start and after an end.
    """
    marked = events.withColumn("mark", F.lit(None).cast("bigint")).unionByName(
        execution_marks(tables), allowMissingColumns=True
    )
    # Chunks are summarised and then met again: stored, the events are taken from the text once.
    marked = stash(marked, "marked")
    filled = running(
        marked.withColumn("_is_event", F.col("mark").isNull()),
        "log_id",
        last={"_current": F.col("mark")},
        chunk_rows=chunk_rows,
    )
    return (
        filled.filter("_is_event")
        .withColumn("current_execution_id", F.nullif(F.col("_current"), F.lit(-1)))
        .drop("_current", "_is_event", "mark")
    )
