"""Detectors: questions over the event tables whose answers are findings.

A detector takes the event tables and returns findings. All of them narrow the events down first, drop
repeats, and only then look up the application and the SQL execution of what is left. Since that takes
several passes over the events, the log text itself is read and parsed once, by whichever runs first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansieve.events import FINAL_PLAN_WORD, PLAN_MARKS, POSITION_CALLS, SORT_MERGE_JOINS
from plansieve.functions.links import DEFAULT_BASE_URL, execution_link, stage_link
from plansieve.operators.context import applications, last_applications, metrics, sql_executions
from plansieve.operators.findings import as_findings
from plansieve.operators.narrow import keep_needed, never_broadcast, stash
from plansieve.plans import cost as costs
from plansieve.plans import tree
from plansieve.sources.decode import EventTables

DETECTORS: dict[str, Callable[..., DataFrame]] = {}
# These ask for a node name, for which there is no default.
NEEDS_OPTIONS = ("node_name", "outer_join_over")
EXECUTIONS = "executions"


def detector(name: str) -> Callable:
    """Register a function (tables, **options) -> findings under ``name``."""

    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        DETECTORS[name] = fn
        return fn

    return register


def run_detectors(
    tables: EventTables, names: list[str] | None = None, save_to: str | None = None, **options: dict
) -> DataFrame:
    """Findings of the named detectors; ``options`` maps a name to its arguments.

    Without names, all that need no argument or are given one run.

    The log text is read and parsed once for all of them, into ``save_to`` or else the scratch folder, and the
    context of findings is gathered once.
    """
    if save_to:
        tables = tables.save(save_to)
    findings = None
    if names is None:
        names = [n for n in sorted(DETECTORS) if n in options or n not in NEEDS_OPTIONS]
    if len(names) > 1:
        tables = tables.once()
        tables.keep(EXECUTIONS, lambda: stash(sql_executions(tables), EXECUTIONS))
    for name in names:
        found = DETECTORS[name](tables, **options.get(name, {}))
        findings = found if findings is None else findings.unionByName(found)
    return findings


def executions_of(found: DataFrame, tables: EventTables, query_ids: bool = True) -> DataFrame:
    """The SQL executions that stored rows name."""
    needed = found.select("log_id", "execution_id")
    return keep_needed(tables.kept(EXECUTIONS), needed) if tables.kept(EXECUTIONS) else sql_executions(tables, needed, query_ids)


def with_context(found: DataFrame, tables: EventTables, base_url: str = DEFAULT_BASE_URL, executions: DataFrame | None = None) -> DataFrame:
    """Add ``url`` and the SQL execution's columns to (log_id, execution_id, ...) rows.

    ``found`` is stored first; while it is small, only its own executions are gathered from the logs. Who has them already gives
    them as ``executions``.
    """
    found, tables = stash(found, "found"), tables.once()
    apps = applications(tables).select("log_id", "app_id", "attempt_id")
    executions = executions_of(found, tables) if executions is None else executions
    return (
        found.join(never_broadcast(executions), ["log_id", "execution_id"], "left")
        .join(never_broadcast(apps), "log_id", "left")
        .withColumn("url", execution_link(F.col("app_id"), F.col("attempt_id"), F.col("execution_id"), base_url))
        .drop("app_id", "attempt_id")
    )


def match_nodes(
    tables: EventTables,
    predicate: Column,
    words: tuple[str, ...] = (),
    include_initial_plans: bool = False,
    where: Column | None = None,
) -> DataFrame:
    """Plan nodes for which a predicate over the node columns holds.

    ``words`` are texts every matching plan must contain: on text, other plans are skipped unparsed. ``where`` is a condition on
    what is known of a plan without its nodes (:func:`tree.has_name`, :func:`tree.has_mark`): of saved tables, other plans' nodes
    are then not looked at.
    """
    updates = tree.plan_updates(tables, include_initial_plans, words)
    if where is not None:
        updates = updates.filter(where)
    return tree.plan_nodes(updates).filter(predicate)


def _words(*words: str) -> tuple[str, ...]:
    return tuple(w for w in words if tree.json_plain(w))


@detector("node_name")
def node_name_search(tables: EventTables, node_name: str, base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """Executions whose plan has a node of the given name."""
    words = _words(node_name)
    tables = tables.once(words)
    nodes = match_nodes(tables, F.col("node_name") == node_name, words, where=tree.has_name(node_name))
    found = nodes.select("log_id", "execution_id", "node_name").dropDuplicates()
    return as_findings(with_context(found, tables, base_url), "node_name", ["node_name"])


@detector("dynamic_pruning")
def dynamic_pruning(tables: EventTables, base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """Executions that prune partitions by a broadcast subquery at run time."""
    words = (PLAN_MARKS["dynamic_pruning"],)
    tables = tables.once(words)
    nodes = match_nodes(
        tables,
        (F.col("node_name") == "SubqueryBroadcast") & F.col("simple_string").startswith(PLAN_MARKS["dynamic_pruning"]),
        words,
        where=tree.has_mark("dynamic_pruning"),
    )
    found = nodes.select("log_id", "execution_id").dropDuplicates()
    return as_findings(with_context(found, tables, base_url), "dynamic_pruning", [])


@detector("outer_join_over")
def outer_join_over(tables: EventTables, child_name: str, base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """Outer sort-merge joins whose preserved side is directly a node of the given name."""
    words = ("SortMergeJoin", *_words(child_name))
    tables = tables.once(words)
    updates = tree.plan_updates(tables, words=words).filter(tree.has_mark("left_outer", "right_outer") & tree.has_name(child_name))
    nodes = F.col("nodes")

    def outer_over(child: Column) -> Column:
        # The child looks up its parent in the plan's own array.
        parent, side = tree.node_at(nodes, child["parent_no"]), child["child_pos"]
        text = parent["simple_string"]
        return (
            (child["node_name"] == child_name)
            & text.startswith("SortMergeJoin")
            & (((side == 0) & text.contains("LeftOuter")) | ((side == 1) & text.contains("RightOuter")))
        )

    found = updates.filter(F.exists(nodes, outer_over)).select("log_id", "execution_id").dropDuplicates()
    return as_findings(with_context(found, tables, base_url), "outer_join_over", [])


@detector("uneven_shuffle")
def uneven_shuffle(
    tables: EventTables, parents: tuple[str, ...] = SORT_MERGE_JOINS, base_url: str = DEFAULT_BASE_URL
) -> DataFrame:
    """Sort-merge joins of a plain shuffle with a shuffle whose partitions were coalesced."""
    words = ("SortMergeJoin", PLAN_MARKS["coalesced"])
    tables = tables.once(words)
    updates = tree.plan_updates(tables, words=words).filter(tree.has_mark("sort_merge") & tree.has_mark("coalesced"))
    # Only readers below such joins name a metric of interest, so few of all metrics are gathered.
    reached = stash(tree.shuffles_below_inputs(updates, parents), "reached")
    needed = reached.select("log_id", F.col("partitions_id").alias("accumulator_id"))
    joins = tree.uneven_joins(reached, metrics(tables, needed))
    found = joins.groupBy("log_id", "execution_id").agg(F.bool_or("unclear").alias("unclear"))
    return as_findings(with_context(found, tables, base_url), "uneven_shuffle", ["unclear"])


def string_match_kind(text: Column) -> Column:
    position = F.lit(False)
    for call in POSITION_CALLS:
        position = position | text.contains(call)
    return F.when(text.contains(" LIKE "), F.lit("LIKE")).when(position, F.lit("POSITION"))


def nested_loop_matches(tables: EventTables, base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """(log_id, execution_id, kind, url, query_id, sql, start_ms, end_ms, duration_ms, seconds)."""
    kind = string_match_kind(F.col("simple_string"))
    words = (PLAN_MARKS["nested_loop"],)
    tables = tables.once(words)
    where = tree.has_mark("nested_loop") & tree.has_mark("like", "position", "locate")
    nodes = match_nodes(tables, (F.col("node_name") == "BroadcastNestedLoopJoin") & kind.isNotNull(), words, where=where)
    found = nodes.select("log_id", "execution_id", kind.alias("kind")).dropDuplicates()
    return with_context(found, tables, base_url).withColumn("seconds", F.expr("duration_ms DIV 1000"))


@detector("nested_loop_string_match")
def nested_loop_string_match(tables: EventTables, base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """Nested-loop joins forced by a string match."""
    return as_findings(
        nested_loop_matches(tables, base_url),
        "nested_loop_string_match",
        ["kind", "query_id", "start_ms", "end_ms", "seconds"],
    )


def _task_columns() -> list[Column]:
    info, took = F.col("Task Info"), F.col("Task Metrics")
    return [
        F.col("log_id"),
        F.col("Stage ID").alias("stage_id"),
        F.col("Stage Attempt ID").alias("stage_attempt"),
        F.col("Task End Reason")["Reason"].alias("reason"),
        info["Task ID"].alias("task_id"),
        info["Executor ID"].alias("executor_id"),
        info["Host"].alias("host"),
        info["Launch Time"].alias("launch_ms"),
        info["Getting Result Time"].alias("getting_result_ms"),
        info["Finish Time"].alias("finish_ms"),
        took["Executor Deserialize Time"].alias("deserialize_ms"),
        took["Executor Run Time"].alias("run_ms"),
        took["Result Serialization Time"].alias("serialize_ms"),
        took["JVM GC Time"].alias("gc_ms"),
        took["Result Size"].alias("result_size"),
    ]


def task_ends(tables: EventTables) -> DataFrame:
    """(log_id, stage_id, stage_attempt, reason, task_id, executor_id, host, times in ms, result_size)."""
    return tables.of("task").select(*_task_columns())


def _delay() -> Column:
    """Time a task spent neither running nor moving data; NULL unless it succeeded."""
    handed_over = F.when(F.col("getting_result_ms") > F.col("launch_ms"), F.col("getting_result_ms"))
    on_driver = F.coalesce(handed_over, F.col("finish_ms")) - F.col("launch_ms")
    delay = on_driver - (F.col("deserialize_ms") + F.col("run_ms") + F.col("serialize_ms"))
    return F.when(F.col("reason") == "Success", delay)


def schedule_delays(tables: EventTables, threshold_ms: int = 4 * 60 * 1000) -> DataFrame:
    """Successful tasks whose ``delay_ms``, time spent neither running nor moving data, is above a threshold."""
    return task_ends(tables).withColumn("delay_ms", _delay()).filter(F.col("delay_ms") > threshold_ms)


@detector("schedule_delay")
def schedule_delay(tables: EventTables, threshold_ms: int = 4 * 60 * 1000, base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """Tasks that waited too long to be scheduled."""
    details = ["stage_id", "stage_attempt", "task_id", "executor_id", "host", "delay_ms", "gc_ms", "result_size"]
    # Tasks are the bulk of a log. One pass picks the slow ones and the application ids out together.
    app_fields = ["App ID", "App Attempt ID", "App Name", "Timestamp"]
    picked = (
        tables.of("task", "app")
        .select("ord", "kind", *app_fields, *_task_columns())
        .withColumn("delay_ms", _delay())
        .filter((F.col("kind") == "app") | (F.col("delay_ms") > threshold_ms))
        .select("log_id", "ord", "kind", *app_fields, *details)
    )
    picked = stash(picked, "delays")
    apps = last_applications(picked.filter(F.col("kind") == "app")).select("log_id", "app_id")
    found = (
        picked.filter(F.col("kind") == "task")
        .select("log_id", *details)
        .dropDuplicates()
        .join(apps, "log_id", "left")
        .withColumn("url", stage_link(F.col("app_id"), F.col("stage_id"), F.col("stage_attempt"), base_url))
        .withColumn("execution_id", F.lit(None).cast("bigint"))
        .withColumn("sql", F.lit(None).cast("string"))
    )
    return as_findings(found, "schedule_delay", details)


# What the line of a plan with an inner join contains; only final plans tell how many rows passed.
COSTLY_WORDS = (FINAL_PLAN_WORD, "Join", "Inner")


def final_outlines(tables: EventTables) -> DataFrame:
    """(plan key, outline) of the final plans with inner joins."""
    final = tree.plan_updates(tables, words=COSTLY_WORDS).filter("is_final").filter(tree.has_mark("inner"))
    return costs.outlines(final).filter(F.exists("outline", lambda n: n["is_inner_join"]))


def _costly(
    tables: EventTables, min_duration_ms: int, big_rows: int, small_rows: int, agg_input_rows: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The joins found, the plans that may hold one (plan key, outline, known), and the executions of the joins; all stored."""
    outlined = stash(final_outlines(tables), "outlines")
    if big_rows >= 0:
        likely = costs.with_big_and_small(outlined, metrics(tables), big_rows, small_rows)
    else:
        # A count that was never written is no big one, but above a number below it.
        likely = costs.with_known(outlined, metrics(tables))
    likely = stash(likely, "likely")
    found = stash(costs.small_side_joins(costs.simplified_cost(likely, None), big_rows, small_rows, agg_input_rows), "joins")
    executions = stash(executions_of(found, tables, query_ids=False), "executions")
    long_ones = executions.filter(F.col("duration_ms") > min_duration_ms).select("log_id", "execution_id")
    joins = found.join(never_broadcast(long_ones), ["log_id", "execution_id"], "left_semi").select(*found.columns)
    return joins, likely, executions


def costly_small_side_joins(
    tables: EventTables,
    min_duration_ms: int = 30,
    big_rows: int = 100_000_000,
    small_rows: int = 100_000,
    agg_input_rows: int = 1_000_000,
) -> DataFrame:
    """(plan key, node_no, rows, left_rows, right_rows) of inner joins that a small side should have made cheap.

    Few joins are such, while nearly all executions take ``min_duration_ms``: how long they took is asked last, for the joins found.
    """
    return _costly(tables.once(COSTLY_WORDS, without=("job",)), min_duration_ms, big_rows, small_rows, agg_input_rows)[0]


@detector("costly_small_side_join")
def costly_small_side_join(
    tables: EventTables,
    min_duration_ms: int = 30,
    big_rows: int = 100_000_000,
    small_rows: int = 100_000,
    agg_input_rows: int = 1_000_000,
    base_url: str = DEFAULT_BASE_URL,
) -> DataFrame:
    """Large inner joins that keep only as many rows as their small side, with both cost trees drawn."""
    tables = tables.once(COSTLY_WORDS, without=("job",))
    joins, likely, executions = _costly(tables, min_duration_ms, big_rows, small_rows, agg_input_rows)
    joins = stash(joins, "joins")
    # Only plans that hold a finding are drawn.
    drawn = stash(keep_needed(likely, joins.select(*tree.PLAN_KEY)), "drawn")
    join_text = costs.cost_text(costs.simplified_cost(drawn, None), joins).withColumnRenamed("text", "join_cost")
    plan_text = costs.cost_text(costs.plan_cost(drawn, None)).withColumnRenamed("text", "plan_cost")
    found = joins.join(join_text, [*tree.PLAN_KEY, "node_no"], "left").join(plan_text, tree.PLAN_KEY, "left")
    return as_findings(
        with_context(found, tables, base_url, executions),
        "costly_small_side_join",
        ["node_no", "rows", "left_rows", "right_rows", "plan_cost", "join_cost"],
    )
