"""Every operator as a query over the test tables, each with the SQL that answers it from the columns.

The Spark side builds event-log text from the tables inside Spark and runs the operator on that text; the
SQL side never sees the text. Thresholds are lowered to what the test tables can reach.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from plansieve import samples
from plansieve.events import COMMON_EVENT_TYPES, JOB_START, PLAN_UPDATE, STAGE_COMPLETED
from plansieve.functions import text
from plansieve.functions.links import execution_link, stage_link
from plansieve.operators import compare, context, detectors, findings, tables as table_audit
from plansieve.operators.narrow import stash
from plansieve.operators.ordered import running
from plansieve.plans import cost, tree
from plansieve.session import scratch_path
from plansieve.sinks.files import read_findings, save_findings
from plansieve.sources import console, lines
from plansieve.sources.decode import EventTables, corrupt_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE_URL = "http://h/history"


def query(oracle: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def _context(spark: SparkSession, sf: str) -> EventTables:
    return EventTables.from_lines(samples.context_lines(spark, sf))


def _tasks(spark: SparkSession, sf: str) -> EventTables:
    return EventTables.from_lines(samples.task_lines(spark, sf))


def _plans(spark: SparkSession, sf: str) -> EventTables:
    return EventTables.from_lines(samples.plan_lines(spark, sf))


def _trees(spark: SparkSession, sf: str) -> DataFrame:
    return tree.plan_trees(tree.plan_updates(_plans(spark, sf)))


def _writers(spark: SparkSession) -> int:
    """Tasks that write many small files: their number takes the time, and left to the few bytes in them Spark would use one task."""
    return 4 * spark.sparkContext.defaultParallelism


def _by_tasks(rows: DataFrame) -> DataFrameWriter:
    """Tasks move their own files: at the end, one thread of the driver would move all."""
    return rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2)


def _write_files(rows: DataFrame, path: str, size: int) -> None:
    """Text files of exactly ``size`` rows and one of what is left, written by many tasks; rows are numbered ``no`` from 1."""
    # A range of file numbers is whole files.
    dealt = rows.repartitionByRange(_writers(rows.sparkSession), F.expr(f"(no - 1) DIV {size}")).select("value")
    _by_tasks(dealt).option("maxRecordsPerFile", size).text(path)


def _event_id(df: DataFrame) -> DataFrame:
    return df.withColumn("event_id", F.col("ord").cast("bigint")).drop("ord")


def _long(*columns: str) -> list:
    return [F.col(c).cast("bigint").alias(c) for c in columns]


# --- SQL shared by the oracles -------------------------------------------------------------------------

EVENTS = """
WITH e AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, 'application_' || user_id AS log_id,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events)
"""

EXECUTIONS = (
    EVENTS.rstrip()
    + """,
st AS (
  SELECT log_id, k % 5 AS execution_id, max(event_id) AS at, arg_max(ms, event_id) AS start_ms,
         arg_max('q ' || k, event_id) AS sql
  FROM e WHERE event_type = 'signup' GROUP BY ALL),
en AS (
  SELECT st.log_id, st.execution_id, arg_max(e.ms, e.event_id) AS end_ms
  FROM st JOIN e ON e.log_id = st.log_id AND e.k % 5 = st.execution_id AND e.event_type = 'purchase' AND e.event_id > st.at
  GROUP BY ALL),
jb AS (
  SELECT st.log_id, st.execution_id, arg_max('g' || e.k, e.event_id) AS query_id
  FROM st JOIN e ON e.log_id = st.log_id AND e.k % 5 = st.execution_id AND e.event_type = 'click' AND e.event_id > st.at
  GROUP BY ALL),
x AS (
  SELECT st.log_id, st.execution_id, query_id, sql, start_ms, end_ms, end_ms - start_ms AS duration_ms
  FROM st LEFT JOIN en USING (log_id, execution_id) LEFT JOIN jb USING (log_id, execution_id))
"""
)

METRICS = (
    EVENTS.rstrip()
    + """,
u AS (
  SELECT log_id, k % 30 AS accumulator_id, event_id, CASE WHEN event_type = 'view' AND k % 10 = 0 THEN 0 ELSE event_id END AS value
  FROM e WHERE event_type = 'error' OR (event_type = 'view' AND k % 10 <> 1)),
m AS (SELECT log_id, accumulator_id, arg_max(value, event_id) AS value FROM u GROUP BY ALL)
"""
)

PLANS = """
WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS c, 'application_' || o_custkey AS log_id,
         CAST(floor(o_totalprice) AS BIGINT) AS lr, epoch_us(o_orderdate) // 1000 AS ms, o_orderkey % 4 AS w,
         o_custkey % 3 AS ls, (o_custkey // 3) % 3 AS rs, o_orderkey % 5 AS jk, o_orderkey % 4 >= 2 AS f,
         o_orderkey % 6 = 0 AS sb, 10 + o_orderkey % 3 AS hp,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN -1 ELSE 10 + (o_orderkey // 3) % 3 END AS np,
         least(CAST(floor(o_totalprice) AS BIGINT), o_custkey) + CASE WHEN o_orderkey % 7 = 1 THEN 1 ELSE 0 END AS jr,
         least(CAST(floor(o_totalprice) AS BIGINT), o_custkey) + CASE WHEN o_orderkey % 7 = 2 THEN 1 ELSE 0 END AS fr,
         o_custkey * (1 + o_orderkey % 4) AS rr
  FROM orders),
p AS (
  SELECT *, w + 1 AS j, w + 2 AS l, CASE WHEN ls = 1 THEN 3 ELSE 2 END AS nl, CASE WHEN rs = 1 THEN 3 ELSE 2 END AS nr,
         rtrim(repeat('0.', CAST(w + 1 AS INTEGER)), '.') AS jp FROM o),
n AS (
  SELECT k, log_id, 0 AS no, '' AS path, 'AdaptiveSparkPlan' AS name,
         'AdaptiveSparkPlan isFinalPlan=' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS txt,
         CASE WHEN sb THEN 2 ELSE 1 END AS nc, false AS has_rows, 'root' AS place FROM p
  UNION ALL SELECT k, log_id, i, rtrim(repeat('0.', CAST(i AS INTEGER)), '.'), CASE WHEN f AND i = 1 THEN 'Filter' ELSE 'Project' END,
         CASE WHEN f AND i = 1 THEN 'Filter (a#1L > 0)' ELSE 'Project [a#1L]' END, 1, f AND i = 1, 'step'
         FROM p, (SELECT unnest([1, 2, 3]) AS i) s WHERE i <= w
  UNION ALL SELECT k, log_id, j, jp,
         CASE jk WHEN 0 THEN 'SortMergeJoin' WHEN 1 THEN 'SortMergeJoin' WHEN 4 THEN 'BroadcastHashJoin' ELSE 'BroadcastNestedLoopJoin' END,
         CASE jk WHEN 0 THEN 'SortMergeJoin [a#1], [b#2], Inner' WHEN 1 THEN 'SortMergeJoin [a#1L], [b#2L, c#3], LeftOuter'
           WHEN 2 THEN 'BroadcastNestedLoopJoin BuildRight, Inner, name#3 LIKE x#4'
           WHEN 3 THEN 'BroadcastNestedLoopJoin BuildRight, Inner, (locate(x#1, y#2, 1) > 0)'
           ELSE 'BroadcastHashJoin [a#1L], [b#2L], Inner, BuildRight, false' END, 2, true, 'join' FROM p
  UNION ALL SELECT k, log_id, l, jp || '.0', CASE WHEN k % 3 = 0 THEN 'PartitionRecombination' ELSE 'Sort' END,
         CASE WHEN k % 3 = 0 THEN 'PartitionRecombination' ELSE 'Sort [a#1L ASC]' END, 1, false, 'left' FROM p
  UNION ALL SELECT k, log_id, l + 1, jp || '.0.0', 'AQEShuffleRead', 'AQEShuffleRead coalesced', 1, false, 'left reader' FROM p WHERE ls = 1
  UNION ALL SELECT k, log_id, l + nl - 1, jp || '.0.0' || CASE WHEN ls = 1 THEN '.0' ELSE '' END,
         CASE WHEN ls = 2 THEN 'BroadcastExchange' ELSE 'Exchange' END,
         CASE WHEN ls = 2 THEN 'BroadcastExchange HashedRelationBroadcastMode'
           ELSE 'Exchange hashpartitioning(a#' || k || 'L, ' || hp || '), ENSURE_REQUIREMENTS, [plan_id=' || k || ']' END, 1, false, 'left exchange' FROM p
  UNION ALL SELECT k, log_id, l + nl, jp || '.0.0.0' || CASE WHEN ls = 1 THEN '.0' ELSE '' END, 'Scan parquet ',
         'FileScan parquet db1.left_t[a#1L,b#2] Batched: true', 0, true, 'left scan' FROM p
  UNION ALL SELECT k, log_id, l + nl + 1, jp || '.1', 'HashAggregate', 'HashAggregate(keys=[b#2], functions=[])', 1, true, 'right' FROM p
  UNION ALL SELECT k, log_id, l + nl + 2, jp || '.1.0', 'AQEShuffleRead', 'AQEShuffleRead coalesced', 1, false, 'right reader' FROM p WHERE rs = 1
  UNION ALL SELECT k, log_id, l + nl + nr, jp || '.1.0' || CASE WHEN rs = 1 THEN '.0' ELSE '' END,
         CASE WHEN rs = 2 THEN 'BroadcastExchange' ELSE 'Exchange' END,
         CASE WHEN rs = 2 THEN 'BroadcastExchange HashedRelationBroadcastMode'
           ELSE 'Exchange hashpartitioning(b#' || k || 'L, ' || hp || '), ENSURE_REQUIREMENTS, [plan_id=' || k || ']' END, 1, false, 'right exchange' FROM p
  UNION ALL SELECT k, log_id, l + nl + nr + 1, jp || '.1.0.0' || CASE WHEN rs = 1 THEN '.0' ELSE '' END, 'Scan parquet ',
         'FileScan parquet db1.right_t[a#1L,b#2] Batched: true', 0, true, 'right scan' FROM p
  UNION ALL SELECT k, log_id, l + nl + nr + 2, '1', 'SubqueryBroadcast',
         CASE WHEN k % 12 = 0 THEN 'SubqueryBroadcast other#7' ELSE 'SubqueryBroadcast dynamicpruning#7, 0' END, 0, false, 'subquery' FROM p WHERE sb),
q AS (
  SELECT k, log_id, 'select ' || k % 50 || ' from t' AS sql, CASE WHEN k % 9 <> 0 THEN 'g' || k % 10 END AS query_id, ms AS start_ms,
         CASE WHEN k % 13 <> 0 THEN ms + k % 97 * 1000 + 500 END AS end_ms,
         'http://h/history/' || log_id || CASE WHEN c % 2 = 1 THEN '/1' ELSE '' END || '/SQL/execution/?id=' || k AS url
  FROM o)
"""

SHUFFLES = (
    PLANS.rstrip()
    + """,
h AS (
  SELECT k, log_id, j AS parent_no, 0 AS side, l + 1 AS node_no, CASE WHEN ls = 0 THEN 'Exchange' ELSE 'AQEShuffleRead' END AS node_name,
         CASE WHEN ls = 1 THEN hp END AS hash_partitions, CASE WHEN ls = 1 THEN np END AS partitions
  FROM p WHERE jk IN (0, 1) AND (ls = 0 OR (ls = 1 AND np <> hp))
  UNION ALL
  SELECT k, log_id, j, 1, l + nl + 2, CASE WHEN rs = 0 THEN 'Exchange' ELSE 'AQEShuffleRead' END,
         CASE WHEN rs = 1 THEN hp END, CASE WHEN rs = 1 THEN np END
  FROM p WHERE jk IN (0, 1) AND (rs = 0 OR (rs = 1 AND np <> hp))),
v AS (
  SELECT a.k, a.log_id, a.parent_no, CASE WHEN a.node_name = 'Exchange' THEN 0 ELSE 1 END AS exchange_side,
         coalesce(a.hash_partitions, b.hash_partitions) AS hash_partitions, coalesce(a.partitions, b.partitions) AS partitions
  FROM h a JOIN h b ON a.k = b.k AND a.side = 0 AND b.side = 1 AND (a.node_name = 'Exchange') <> (b.node_name = 'Exchange'))
"""
)

COSTS = (
    PLANS.rstrip()
    + """,
c0 AS (
  SELECT k, log_id, 0 AS node_no, NULL AS parent_no, 0 AS rows, 'AdaptiveSparkPlan' AS name FROM p WHERE sb
  UNION ALL SELECT k, log_id, 1, CASE WHEN sb THEN 0 END, fr, 'Filter' FROM p WHERE f
  UNION ALL SELECT k, log_id, j, CASE WHEN f THEN 1 WHEN sb THEN 0 END, jr, 'Join' FROM p
  UNION ALL SELECT k, log_id, l + nl, j, lr, 'Scan' FROM p
  UNION ALL SELECT k, log_id, l + nl + 1, j, c, 'HashAggregate' FROM p
  UNION ALL SELECT k, log_id, l + nl + nr + 1, l + nl + 1, rr, 'Scan' FROM p
  UNION ALL SELECT k, log_id, l + nl + nr + 2, 0, 0, 'SubqueryBroadcast' FROM p WHERE sb),
pr AS (
  SELECT a.k, a.log_id, a.node_no, a.rows,
         CASE WHEN count(b.k) = 0 OR bool_or(b.rows = a.rows) THEN 10000
           WHEN max(b.rows) > 0 THEN 10000 * a.rows // max(b.rows) END AS priority
  FROM c0 a LEFT JOIN c0 b ON b.k = a.k AND b.parent_no = a.node_no GROUP BY a.k, a.log_id, a.node_no, a.rows)
"""
)

RUNS = """
WITH r AS (
  SELECT o_custkey AS query, o_orderstatus AS variant, o_orderkey AS run_no, CAST(floor(o_totalprice / 1000) AS BIGINT) AS elapsed_ms,
         'Scan a#' || o_orderkey % 3 || 'L Filter a#' || o_orderkey % 2 || 'L' AS plan FROM orders),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query, variant ORDER BY elapsed_ms, plan) - 1 AS i,
         count(*) OVER (PARTITION BY query, variant) AS n_runs FROM r),
md AS (SELECT query, variant, n_runs, elapsed_ms, plan FROM ranked WHERE i = n_runs // 2),
ch AS (
  SELECT query, (arg_max(run_no % 3 = run_no % 2, run_no) FILTER (variant = 'O'))
             <> (arg_max(run_no % 3 = run_no % 2, run_no) FILTER (variant = 'F')) AS changed
  FROM r WHERE variant IN ('O', 'F') GROUP BY query HAVING count(DISTINCT variant) = 2)
"""

CONSOLE = """
WITH t AS (
  SELECT *, 'container_' || conv_id AS log_id,
         last_value(CASE WHEN role = 'user' THEN 'http://h/' || conv_id || '/' || turn END IGNORE NULLS)
           OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS url,
         count(*) FILTER (role IN ('user', 'assistant')) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS block_no
  FROM conversations),
b AS (SELECT log_id, block_no, url, text AS sql FROM t WHERE role = 'assistant')
"""

# --- sources and decoding ------------------------------------------------------------------------------


@query("""
SELECT 'application_' || user_id || CASE WHEN user_id % 7 = 0 THEN '.inprogress' ELSE '' END AS name, max(epoch_us(ts) // 1000) AS mtime_ms,
       CAST((1706659200000 - max(epoch_us(ts) // 1000) - 1) // 86400000 AS BIGINT) AS day_before
FROM events GROUP BY user_id
HAVING user_id % 7 <> 0 AND user_id % 11 <> 0 AND max(epoch_us(ts) // 1000) < 1706659200000 AND max(epoch_us(ts) // 1000) >= 1706659200000 - 7 * 86400000
""")
def list_logs_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """Finished logs of the last seven days; each event of a user is a part of the user's log.

    Like the listing's glob, the rows leave out files of other names.
    """
    log_id = F.concat(F.lit("file:/logs/application_"), F.col("user_id"))
    ms = F.expr(f"timestampdiff(MILLISECOND, {samples.EPOCH}, ts)")
    parts = samples.table(spark, sf, "events").where("user_id % 11 <> 0").select(
        log_id.alias("log_id"), F.concat(log_id, F.lit("/events_"), F.col("event_id")).alias("path"), F.lit(1).cast("long").alias("length"),
        ms.alias("mtime_ms"), F.lit(True).alias("is_part"), F.lit(False).alias("is_open"), "user_id",
    )
    # Running logs have a marker beside their parts.
    running = parts.where("user_id % 7 = 0").select(
        "log_id", F.concat("log_id", F.lit("/appstatus.inprogress")), F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(False), F.lit(True), "user_id"
    )
    logs = lines.finished_logs(parts.union(running.distinct()).drop("user_id"), now_ms=1706659200000, days=7).orderBy("mtime_ms", "log_id")
    return logs.select("name", "mtime_ms", *_long("day_before"))


@query("""
SELECT 'eventlog_v2_application=' || user_id AS name, CAST(ceil(count(*) / 50.0) AS BIGINT) AS n_files, CAST(sum(length('line ' || event_id) + 1) AS BIGINT) AS length,
       CAST(0 AS BIGINT) AS day_before, count(*) AS n_lines
FROM events GROUP BY user_id
""")
def list_log_files(spark: SparkSession, sf: str) -> DataFrame:
    """O1, O2: rolled logs written as files of at most 50 lines each, listed into a manifest, chosen and read by it."""
    path, manifest = scratch_path(spark, "logs"), scratch_path(spark, "manifest")
    events = samples.table(spark, sf, "events").select("user_id", F.concat(F.lit("line "), F.col("event_id")).alias("value"))
    written = events.withColumnRenamed("user_id", "eventlog_v2_application").repartition(_writers(spark), "eventlog_v2_application")
    _by_tasks(written).partitionBy("eventlog_v2_application").option("maxRecordsPerFile", 50).text(path)
    logs = lines.update_manifest(spark, path, manifest, file_glob="part-*")
    # A second listing finds nothing new.
    logs = lines.update_manifest(spark, path, manifest, file_glob="part-*")
    chosen = lines.in_window(logs, now_ms=int(time.time() * 1000) + 60_000, days=1)
    read = lines.read_logs(chosen, group=1000).groupBy("log_id").agg(F.count("*").alias("n_lines"))
    return chosen.join(read, "log_id").select("name", *_long("n_files", "length", "day_before"), "n_lines")


@query(METRICS + "SELECT log_id, accumulator_id, value FROM m")
def read_rolled_logs(spark: SparkSession, sf: str) -> DataFrame:
    """O2, O3: lines written to files and read back; last-write-wins values show that line order survived.

    The files are range-partitioned by log and line, so a large log is spread over several numbered parts.
    """
    path = scratch_path(spark, "logs")
    written = samples.context_lines(spark, sf).repartitionByRange(_writers(spark), "log_id", "ord").sortWithinPartitions("log_id", "ord")
    _by_tasks(written.select("log_id", "value")).partitionBy("log_id").text(path)
    read = lines.read_log_lines(
        spark, path, file_glob="part-*", log_id_pattern=r"/log_id=([^/]+)/", part_pattern=r"/part-(\d+)-[^/]*$"
    )
    return context.metrics(EventTables.from_lines(read))


@query(EVENTS + f"""
SELECT log_id, event_id, CASE event_type WHEN 'click' THEN '{JOB_START}' ELSE '{STAGE_COMPLETED}' END AS event_type
FROM e WHERE event_type IN ('click', 'view')
""")
def filter_event_types(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of two event types, found without parsing JSON."""
    kept = lines.filter_event_types(samples.context_lines(spark, sf), [JOB_START, STAGE_COMPLETED])
    return _event_id(kept).select("log_id", "event_id", "event_type")


@query(EVENTS + """
SELECT CASE event_type WHEN 'signup' THEN 'SparkListenerSQLExecutionStart' WHEN 'purchase' THEN 'SparkListenerSQLExecutionEnd'
         WHEN 'click' THEN 'SparkListenerJobStart' WHEN 'error' THEN 'SparkListenerDriverAccumUpdates'
         ELSE 'SparkListenerStageCompleted' END AS event, count(*) AS n FROM e GROUP BY 1
UNION ALL SELECT 'SparkListenerApplicationStart', (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(DISTINCT l_suppkey) FROM lineitem)
""")
def default_event_types(spark: SparkSession, sf: str) -> DataFrame:
    """The default event set over context and task logs; task ends are not part of it."""
    both = samples.context_lines(spark, sf).unionByName(samples.task_lines(spark, sf))
    kept = lines.filter_event_types(both, COMMON_EVENT_TYPES)
    name = F.element_at(F.split("event_type", r"\."), -1)
    return kept.groupBy(name.alias("event")).agg(F.count(F.lit(1)).alias("n"))


@query(EVENTS + """
SELECT log_id, event_id, k % 5 AS execution_id, 'q ' || k AS sql, ms AS start_ms FROM e WHERE event_type = 'signup'
""")
def decode_execution_starts(spark: SparkSession, sf: str) -> DataFrame:
    """One event type decoded to typed columns."""
    return _event_id(_context(spark, sf).of("sql_start")).select(
        "log_id",
        "event_id",
        F.col("executionId").alias("execution_id"),
        F.col("description").alias("sql"),
        F.col("time").alias("start_ms"),
    )


@query(EVENTS + """
SELECT log_id, event_id, CASE event_id % 10 WHEN 3 THEN 'broken json' WHEN 7 THEN 'broken plan' ELSE 'no event tag' END AS reason
FROM e WHERE event_id % 10 IN (3, 4, 5, 6) OR event_id % 10 = 7 AND event_id // 10 % 5 < 4
""")
def find_corrupt_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines cut short, indented, emptied, without a tag or with a malformed plan are listed and do not stop the rest."""
    return _event_id(corrupt_lines(_damaged(spark, sf))).select("log_id", "event_id", "reason")


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    logs = samples.context_lines(spark, sf)
    damage = F.col("ord") % 10
    value = F.col("value")
    # Plan updates whose node has, in turn, a null child, text for children, text for a metric id, a number for a name, or no fault.
    head = F.concat(F.lit(f'{{"Event":"{PLAN_UPDATE}","executionId":'), F.col("ord"), F.lit(',"sparkPlanInfo":{"nodeName":'))
    faults = [
        '"A","children":[null],"metrics":[]', '"A","children":"x","metrics":[]', '"A","children":[],"metrics":[{"name":"m","accumulatorId":"7"}]',
        '1,"children":[],"metrics":[]', '"A","simpleString":"A","children":[],"metrics":[]',
    ]
    plan = F.concat(head, F.get(F.array(*map(F.lit, faults)), (F.floor(F.col("ord") / 10) % 5).cast("int")), F.lit("}}"))
    return logs.withColumn(
        "value",
        F.when(damage == 3, F.expr("substr(value, 1, length(value) - 1)"))
        .when(damage == 4, F.concat(F.lit(" "), value))
        .when(damage == 5, F.lit(""))
        .when(damage == 6, F.regexp_replace(value, '"Event"', '"event"'))
        .when(damage == 7, plan)
        .otherwise(value),
    )


@query(ORACLES["find_corrupt_lines"])
def find_corrupt_lines_saved(spark: SparkSession, sf: str) -> DataFrame:
    """The same lines of saved tables."""
    saved = EventTables.from_lines(_damaged(spark, sf)).save(scratch_path(spark, "events"))
    return _event_id(saved.corrupt()).select("log_id", "event_id", "reason")


@query(EVENTS + f"""
SELECT DISTINCT log_id, '{{"Event":"{STAGE_COMPLETED}","Stage Info":{{"Stage ID":' || k || ',"Stage Attempt ID":0,"Accumulables":[{{"ID":' || k % 30
       || ',"Name":"m","Value":"List([a])"}}]}}}}' AS value
FROM e WHERE event_type = 'view' AND k % 10 = 0
""")
def search_raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct lines that contain a text."""
    return lines.search_lines(samples.context_lines(spark, sf), "List([a])")


@query(EXECUTIONS + "SELECT * FROM x")
def save_and_open_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Events parsed once into a saved table, then read from it."""
    return context.sql_executions(_context(spark, sf).save(scratch_path(spark, "events")))


# --- context -------------------------------------------------------------------------------------------


@query("""
SELECT DISTINCT 'application_' || user_id AS log_id, 'application_' || user_id AS app_id,
       CASE WHEN user_id % 2 = 1 THEN '1' ELSE '' END AS attempt_id, 'app ' || user_id AS app_name, user_id AS start_ms FROM events
""")
def application_context(spark: SparkSession, sf: str) -> DataFrame:
    """O15."""
    return context.applications(_context(spark, sf))


@query(EVENTS + """
, w AS (
  SELECT *, last_value(CASE event_type WHEN 'signup' THEN k % 5 WHEN 'purchase' THEN -1 END IGNORE NULLS)
    OVER (PARTITION BY log_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mark FROM e)
SELECT log_id, event_id, nullif(mark, -1) AS current_execution_id FROM w WHERE event_type = 'error'
""")
def current_execution(spark: SparkSession, sf: str) -> DataFrame:
    """The execution a driver event falls into; chunks are small so that values cross them."""
    tables = _context(spark, sf)
    events = tables.of("driver").select("log_id", "ord")
    return _event_id(context.attribute_to_execution(events, tables, chunk_rows=64))


@query(EXECUTIONS + "SELECT * FROM x")
def sql_execution_table(spark: SparkSession, sf: str) -> DataFrame:
    """O17."""
    return context.sql_executions(_context(spark, sf))


@query(EVENTS + "SELECT log_id, event_id, k % 5 AS execution_id, 'g' || k AS query_id FROM e WHERE event_type = 'click'")
def query_id_links(spark: SparkSession, sf: str) -> DataFrame:
    """O18."""
    return _event_id(context.query_id_links(_context(spark, sf)))


@query(EVENTS + "SELECT log_id, event_id, k % 30 AS accumulator_id, event_id AS value FROM e WHERE event_type = 'error'")
def driver_metric_updates(spark: SparkSession, sf: str) -> DataFrame:
    """O19."""
    return _event_id(context.driver_metric_updates(_context(spark, sf)))


@query(EVENTS + """
SELECT log_id, event_id, k % 30 AS accumulator_id, CASE WHEN k % 10 = 0 THEN 0 ELSE event_id END AS value
FROM e WHERE event_type = 'view' AND k % 10 <> 1
""")
def stage_metric_values(spark: SparkSession, sf: str) -> DataFrame:
    """Text values count 0, entries without a value are skipped."""
    return _event_id(context.stage_metric_updates(_context(spark, sf)))


@query(METRICS + "SELECT log_id, accumulator_id, value FROM m")
def metric_store(spark: SparkSession, sf: str) -> DataFrame:
    """O21."""
    return context.metrics(_context(spark, sf))


@query(METRICS + """
SELECT e.log_id, e.event_id, nullif(e.event_id % 40, 39) AS metric_id,
       CASE WHEN e.event_id % 40 <> 39 THEN coalesce(m.value, -1) END AS value
FROM e LEFT JOIN m ON m.log_id = e.log_id AND m.accumulator_id = e.event_id % 40 WHERE e.event_type = 'click'
""")
def metric_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """-1 for a metric never written, NULL where none is named."""
    tables = _context(spark, sf)
    asked = tables.of("job").select(
        "log_id", "ord", F.lit(0).alias("node_no"), F.nullif(F.col("Job ID") % 40, F.lit(39)).alias("metric_id")
    )
    found = context.lookup_metric(asked, "metric_id", context.metrics(tables), "value")
    return _event_id(found).select("log_id", "event_id", "metric_id", "value")


@query(EXECUTIONS + """
SELECT log_id, execution_id, 'http://h/history/' || log_id || CASE WHEN CAST(substr(log_id, 13) AS BIGINT) % 2 = 1 THEN '/1' ELSE '' END
       || '/SQL/execution/?id=' || execution_id AS url FROM x
""")
def execution_links(spark: SparkSession, sf: str) -> DataFrame:
    """With a slash after a non-empty attempt id."""
    tables = _context(spark, sf)
    url = execution_link(F.col("app_id"), F.col("attempt_id"), F.col("execution_id"), BASE_URL)
    joined = context.sql_executions(tables).join(context.applications(tables), "log_id", "left")
    return joined.select("log_id", "execution_id", url.alias("url"))


@query("""
SELECT DISTINCT 'application_' || l_suppkey AS log_id,
       'http://h/history/application_' || l_suppkey || '/stages/stage/?id=' || l_orderkey || '&attempt=' || l_linenumber AS url
FROM lineitem
""")
def stage_links(spark: SparkSession, sf: str) -> DataFrame:
    """O14."""
    tables = _tasks(spark, sf)
    ends = detectors.task_ends(tables).select("log_id", "stage_id", "stage_attempt").distinct()
    url = stage_link(F.col("app_id"), F.col("stage_id"), F.col("stage_attempt"), BASE_URL)
    return ends.join(context.applications(tables), "log_id").select("log_id", url.alias("url"))


# --- plan trees ----------------------------------------------------------------------------------------


@query(PLANS + "SELECT log_id, k AS execution_id, no AS node_no, path, name AS node_name, txt AS simple_string, nc AS n_children FROM n")
def flatten_plan_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """O24."""
    with_path = F.arrays_zip("nodes", tree.node_paths(F.col("nodes")).alias("path"))
    return _trees(spark, sf).select("log_id", "execution_id", F.inline(with_path)).select("log_id", "execution_id", "path", "nodes.*").select(
        "log_id", "execution_id", *_long("node_no"), "path", "node_name", "simple_string", *_long("n_children")
    )


@query(PLANS + """
SELECT log_id, k AS execution_id, string_agg(name, ',' ORDER BY length(path), path) AS matches FROM n WHERE has_rows GROUP BY ALL
""")
def collect_matching_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes with a row metric, breadth first."""
    has_rows = lambda n: tree.metric_id(n["metrics"], "number of output rows").isNotNull()
    matches = tree.collect_nodes(_trees(spark, sf), has_rows)
    return matches.select(
        "log_id", "execution_id", F.array_join(F.transform("matches", lambda n: n["node_name"]), ",").alias("matches")
    )


@query(PLANS + """
SELECT n.log_id, n.k AS execution_id, n.no AS node_no, CASE WHEN n.name = 'Exchange' THEN p.hp ELSE 0 END AS partitions FROM n JOIN p USING (k)
""")
def hash_partition_count(spark: SparkSession, sf: str) -> DataFrame:
    """Over the text of every node; 0 where it has no such number."""
    partitions = text.hash_partition_count(F.col("simple_string"))
    return tree.plan_nodes(_trees(spark, sf)).select(
        "log_id", "execution_id", *_long("node_no"), partitions.alias("partitions")
    )


@query(PLANS + """
SELECT n.log_id, n.k AS execution_id, n.no AS node_no,
       CASE WHEN place IN ('root', 'step', 'join', 'left', 'left reader', 'left exchange') AND ls < 2
              OR place IN ('right', 'right reader', 'right exchange') AND rs < 2 THEN hp END AS partitions
FROM n JOIN p USING (k)
""")
def subtree_hash_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """For every node of every plan."""
    per_node = F.transform(
        "nodes",
        lambda n: F.struct(
            n["node_no"].cast("bigint").alias("node_no"),
            tree.subtree_hash_partitions(F.col("nodes"), n["node_no"]).alias("partitions"),
        ),
    )
    return _trees(spark, sf).select("log_id", "execution_id", F.inline(per_node))


@query(PLANS + """
, d AS (
  SELECT k, log_id, no, parts, unnest(range(len(parts) + 1)) AS i
  FROM (SELECT k, log_id, no, CASE WHEN path = '' THEN [] ELSE string_split(path, '.') END AS parts FROM n))
SELECT d.log_id, d.k AS execution_id, d.no AS node_no, string_agg(a.no || ':' || (len(d.parts) - d.i), ',' ORDER BY d.i) AS ancestors
FROM d JOIN n a ON a.k = d.k AND a.path = array_to_string(d.parts[1:d.i], '.') GROUP BY ALL
""")
def plan_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """Each node's ancestors from the root down, and itself, with their distance (``0:2,1:1,4:0``)."""
    listed = F.transform("ancestors", lambda a: F.concat_ws(":", a["ancestor_no"].cast("string"), a["distance"].cast("string")))
    return tree.ancestor_lists(_trees(spark, sf)).select(
        "log_id", "execution_id", *_long("node_no"), F.array_join(listed, ",").alias("ancestors")
    )


@query(SHUFFLES + """
SELECT log_id, k AS execution_id, parent_no, side, node_no, node_name, hash_partitions, partitions FROM h
""")
def first_shuffle_under_join(spark: SparkSession, sf: str) -> DataFrame:
    """O29."""
    tables = _plans(spark, sf)
    trees = tree.plan_trees(tree.plan_updates(tables, words=("SortMergeJoin",)))
    return tree.first_shuffles(tree.shuffles_below_inputs(trees), context.metrics(tables)).select(
        "log_id", "execution_id", *_long("parent_no", "side", "node_no"), "node_name", "hash_partitions", "partitions"
    )


@query(SHUFFLES + """
SELECT log_id, k AS execution_id, parent_no, exchange_side, hash_partitions, partitions, partitions = -1 AS unclear FROM v
""")
def match_join_shape(spark: SparkSession, sf: str) -> DataFrame:
    """O30."""
    tables = _plans(spark, sf)
    reached = tree.shuffles_below_inputs(tree.plan_trees(tree.plan_updates(tables)))
    joins = tree.uneven_joins(reached, context.metrics(tables))
    return joins.select(
        "log_id", "execution_id", *_long("parent_no", "exchange_side"), "hash_partitions", "partitions", "unclear"
    )


@query(COSTS + "SELECT log_id, k AS execution_id, node_no, parent_no, rows FROM c0")
def plan_cost_tree(spark: SparkSession, sf: str) -> DataFrame:
    """O31."""
    tables = _plans(spark, sf)
    costs = cost.plan_cost(tree.plan_trees(tree.plan_updates(tables)), context.metrics(tables))
    return cost.cost_nodes(costs).select("log_id", "execution_id", *_long("node_no", "parent_no"), "rows")


@query(COSTS + """
SELECT c0.log_id, k AS execution_id, node_no, CASE WHEN name = 'Join' THEN CASE WHEN sb THEN 0 END ELSE parent_no END AS parent_no,
       CASE WHEN name = 'Join' AND f THEN fr ELSE rows END AS rows
FROM c0 JOIN p USING (k) WHERE name <> 'Filter'
""")
def simplified_cost_tree(spark: SparkSession, sf: str) -> DataFrame:
    """O32."""
    tables = _plans(spark, sf)
    costs = cost.simplified_cost(tree.plan_trees(tree.plan_updates(tables)), context.metrics(tables))
    return cost.cost_nodes(costs).select("log_id", "execution_id", *_long("node_no", "parent_no"), "rows")


@query(COSTS + """
SELECT log_id, k AS execution_id, j AS branch_no, 0 AS branch_side, lr AS rows, lr < 1000 AS is_small FROM p
UNION ALL SELECT log_id, k, j, 1, c, rr < 1000 AND NOT (c < 1000 AND rr > 2000) FROM p
UNION ALL SELECT log_id, k, 0, 0, CASE WHEN f THEN fr ELSE jr END, false FROM p WHERE sb
UNION ALL SELECT log_id, k, 0, 1, 0, true FROM p WHERE sb
""")
def small_join_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """O33."""
    tables = _plans(spark, sf)
    costs = cost.simplified_cost(tree.plan_trees(tree.plan_updates(tables)), context.metrics(tables))
    return cost.small_inputs(costs, small_rows=1000, agg_input_rows=2000).select(
        "log_id", "execution_id", *_long("branch_no", "branch_side"), "rows", "is_small"
    )


@query(COSTS + "SELECT log_id, k AS execution_id, node_no, rows, CAST(priority AS BIGINT) AS priority FROM pr")
def selectivity_priority(spark: SparkSession, sf: str) -> DataFrame:
    """O34."""
    tables = _plans(spark, sf)
    costs = cost.plan_cost(tree.plan_trees(tree.plan_updates(tables)), context.metrics(tables))
    return cost.priorities(costs).select("log_id", "execution_id", *_long("node_no"), "rows", "priority")


@query(COSTS + """
, s AS (
  SELECT k, node_no, rows || ' ' || CASE WHEN priority <> 10000 THEN 'priority = ' || CAST(priority AS BIGINT) || '.0' ELSE '' END || chr(10) AS tail FROM pr),
d AS (
  SELECT p.*, CASE WHEN sb THEN ':- ' ELSE '' END AS b1, CASE WHEN sb THEN ':  ' ELSE '' END AS b2,
         CASE WHEN f THEN CASE WHEN sb THEN ':  +- ' ELSE '+- ' END WHEN sb THEN ':- ' ELSE '' END AS bj,
         CASE WHEN sb THEN ':  ' ELSE '' END || CASE WHEN f THEN '   ' ELSE '' END AS bc FROM p)
, t AS (
  SELECT k, max(tail) FILTER (node_no = 0 AND sb) AS t0, max(tail) FILTER (node_no = 1 AND f) AS t1, max(tail) FILTER (node_no = j) AS tj,
         max(tail) FILTER (node_no = l + nl) AS tl, max(tail) FILTER (node_no = l + nl + 1) AS ta, max(tail) FILTER (node_no = l + nl + nr + 1) AS tr
  FROM d JOIN s USING (k) GROUP BY k)
SELECT d.log_id, d.k AS execution_id,
       CASE WHEN sb THEN 'AdaptiveSparkPlan rows = ' || t0 ELSE '' END
       || CASE WHEN f THEN b1 || 'Filter rows = ' || t1 ELSE '' END
       || bj || CASE jk WHEN 0 THEN 'SortMergeJoin' WHEN 1 THEN 'SortMergeJoin' WHEN 4 THEN 'BroadcastHashJoin' ELSE 'BroadcastNestedLoopJoin' END
       || ' rows = ' || tj
       || bc || ':- Scan parquet  rows = ' || tl
       || bc || '+- HashAggregate rows = ' || ta
       || bc || '   +- Scan parquet  rows = ' || tr
       || CASE WHEN sb THEN '+- SubqueryBroadcast rows = 0 ' || chr(10) ELSE '' END AS text
FROM d JOIN t USING (k)
""")
def cost_tree_text(spark: SparkSession, sf: str) -> DataFrame:
    """O35."""
    tables = _plans(spark, sf)
    costs = cost.plan_cost(tree.plan_trees(tree.plan_updates(tables)), context.metrics(tables))
    return cost.cost_text(costs).select("log_id", "execution_id", "text")


@query(PLANS + """
SELECT log_id, k AS execution_id, no AS node_no, 'db1' AS db, CASE WHEN place = 'left scan' THEN 'left_t' ELSE 'right_t' END AS "table"
FROM n WHERE place IN ('left scan', 'right scan')
""")
def scanned_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes whose text names a table."""
    named = text.scanned_table(F.col("simple_string"))
    return (
        tree.plan_nodes(_trees(spark, sf))
        .select("log_id", "execution_id", *_long("node_no"), named.alias("named"))
        .filter(F.col("named").isNotNull())
        .select("log_id", "execution_id", "node_no", "named.*")
    )


@query(PLANS + """
SELECT log_id, k AS execution_id, CASE WHEN k % 5 IN (0, 1) THEN 'SortMergeJoin' WHEN k % 5 = 4 THEN 'BroadcastHashJoin' ELSE '' END AS name,
       CASE WHEN k % 5 IN (0, 1, 4) THEN 'a' ELSE '' END AS left_keys,
       CASE WHEN k % 5 IN (0, 4) THEN 'b' WHEN k % 5 = 1 THEN 'b,c' ELSE '' END AS right_keys,
       CASE WHEN k % 5 IN (0, 4) THEN 'Inner' WHEN k % 5 = 1 THEN 'LeftOuter' ELSE '' END AS join_type
FROM n WHERE place = 'join'
""")
def join_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of every join's text."""
    parts = text.join_parts(F.col("simple_string"))
    joins = tree.plan_nodes(_trees(spark, sf)).filter(F.col("node_name").endswith("Join"))
    return joins.select("log_id", "execution_id", parts.alias("parts")).select(
        "log_id",
        "execution_id",
        "parts.name",
        F.array_join("parts.left_keys", ",").alias("left_keys"),
        F.array_join("parts.right_keys", ",").alias("right_keys"),
        "parts.join_type",
    )


# --- detectors -----------------------------------------------------------------------------------------


def _finding(found: DataFrame, *details: str) -> DataFrame:
    return found.select("log_id", "execution_id", "url", "sql", *[F.col("detail")[d].alias(d) for d in details])


@query(PLANS + "SELECT 'filtered_plan' AS detector, q.log_id, k AS execution_id, url, sql FROM q JOIN n USING (k) WHERE name = 'Filter'")
def custom_detector(spark: SparkSession, sf: str) -> DataFrame:
    """A detector of the user's own, run through the registry."""

    @detectors.detector("filtered_plan")
    def filtered_plan(tables: EventTables) -> DataFrame:
        tables = tables.once(("Filter",))
        found = detectors.match_nodes(tables, F.col("node_name") == "Filter", ("Filter",), where=tree.has_name("Filter"))
        found = found.select("log_id", "execution_id").dropDuplicates()
        return findings.as_findings(detectors.with_context(found, tables, BASE_URL), "filtered_plan", [])

    try:
        found = detectors.run_detectors(_plans(spark, sf), ["filtered_plan"])
    finally:
        del detectors.DETECTORS["filtered_plan"]
    return found.select("detector", "log_id", "execution_id", "url", "sql")


@query(PLANS + "SELECT q.log_id, k AS execution_id, url, sql FROM q WHERE k % 3 = 0")
def node_name_search(spark: SparkSession, sf: str) -> DataFrame:
    """O38."""
    return _finding(detectors.node_name_search(_plans(spark, sf), "PartitionRecombination", BASE_URL))


@query(PLANS + "SELECT q.log_id, k AS execution_id, url, sql FROM q WHERE k % 6 = 0 AND k % 12 <> 0")
def dynamic_pruning(spark: SparkSession, sf: str) -> DataFrame:
    """O39."""
    return _finding(detectors.dynamic_pruning(_plans(spark, sf), BASE_URL))


@query(PLANS + "SELECT q.log_id, k AS execution_id, url, sql FROM q WHERE k % 5 = 1 AND k % 3 = 0")
def outer_join_over_node(spark: SparkSession, sf: str) -> DataFrame:
    """O40."""
    return _finding(detectors.outer_join_over(_plans(spark, sf), "PartitionRecombination", BASE_URL))


@query(SHUFFLES + """
SELECT q.log_id, q.k AS execution_id, url, sql, CASE WHEN partitions = -1 THEN 'true' ELSE 'false' END AS unclear FROM q JOIN v USING (k)
""")
def uneven_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """O41."""
    return _finding(detectors.uneven_shuffle(_plans(spark, sf), base_url=BASE_URL), "unclear")


@query(PLANS + """
SELECT q.log_id, k AS execution_id, url, query_id, start_ms, end_ms, (end_ms - start_ms) // 1000 AS seconds,
       CASE WHEN k % 5 = 2 THEN 'LIKE' ELSE 'POSITION' END AS kind, sql
FROM q WHERE k % 5 IN (2, 3)
""")
def nested_loop_string_match(spark: SparkSession, sf: str) -> DataFrame:
    """O42."""
    return detectors.nested_loop_matches(_plans(spark, sf), BASE_URL).select(
        "log_id", "execution_id", "url", "query_id", "start_ms", "end_ms", "seconds", "kind", "sql"
    )


@query("""
WITH t AS (
  SELECT *, CAST(l_quantity * 1000 AS BIGINT) AS run,
         (CASE WHEN l_linenumber % 2 = 0 AND l_partkey * 100 - 50 > 0 THEN l_partkey * 100 - 50 ELSE l_partkey * 100 END)
           - (l_partkey % 10 + CAST(l_quantity * 1000 AS BIGINT) + 1) AS delay_ms FROM lineitem)
SELECT DISTINCT 'application_' || l_suppkey AS log_id, 'http://h/history/application_' || l_suppkey || '/stages/stage/?id=' || l_orderkey || '&attempt=' || l_linenumber AS url,
       l_orderkey AS stage_id, CAST(l_linenumber AS BIGINT) AS stage_attempt, l_partkey AS task_id,
       CAST(l_suppkey % 7 AS VARCHAR) AS executor_id, 'h' || l_suppkey % 3 AS host, delay_ms, 2 AS gc_ms, l_partkey AS result_size
FROM t WHERE l_returnflag <> 'R' AND delay_ms > 4000
""")
def schedule_delay(spark: SparkSession, sf: str) -> DataFrame:
    """O43."""
    detail = F.col("detail")
    return detectors.schedule_delay(_tasks(spark, sf), threshold_ms=4000, base_url=BASE_URL).select(
        "log_id",
        "url",
        *[detail[n].cast("bigint").alias(n) for n in ("stage_id", "stage_attempt", "task_id", "delay_ms", "gc_ms", "result_size")],
        *[detail[n].alias(n) for n in ("executor_id", "host")],
    )


@query(COSTS + """
SELECT log_id, k AS execution_id, j AS node_no, CASE WHEN f THEN fr ELSE jr END AS rows, lr AS left_rows, c AS right_rows
FROM p WHERE k % 2 = 0 AND k % 13 <> 0 AND k % 97 * 1000 + 500 > 30 AND jk <> 1
  AND (lr > 200000 AND rr < 1000 AND NOT (c < 1000 AND rr > 2000) OR c > 200000 AND lr < 1000)
  AND CASE WHEN f THEN fr ELSE jr END = least(lr, c)
""")
def costly_small_side_join(spark: SparkSession, sf: str) -> DataFrame:
    """O44."""
    joins = detectors.costly_small_side_joins(
        _plans(spark, sf), min_duration_ms=30, big_rows=200_000, small_rows=1000, agg_input_rows=2000
    )
    return joins.select("log_id", "execution_id", *_long("node_no"), "rows", "left_rows", "right_rows")


@query(COSTS + """
SELECT p.log_id, k AS execution_id, url, sql, CAST(j AS VARCHAR) AS node_no, CAST(lr AS VARCHAR) AS left_rows, CAST(c AS VARCHAR) AS right_rows
FROM p JOIN q USING (k) WHERE k % 2 = 0 AND k % 13 <> 0 AND k % 97 * 1000 + 500 > 30 AND jk <> 1
  AND (lr > 200000 AND rr < 1000 AND NOT (c < 1000 AND rr > 2000) OR c > 200000 AND lr < 1000)
  AND CASE WHEN f THEN fr ELSE jr END = least(lr, c)
""")
def costly_small_side_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The detector, with the context of its findings."""
    found = detectors.costly_small_side_join(
        _plans(spark, sf), min_duration_ms=30, big_rows=200_000, small_rows=1000, agg_input_rows=2000, base_url=BASE_URL
    )
    drawn = found.filter(F.col("detail")["plan_cost"].isNotNull() & F.col("detail")["join_cost"].isNotNull())
    return _finding(drawn, "node_no", "left_rows", "right_rows")


@query(SHUFFLES + """
SELECT 'dynamic_pruning' AS detector, log_id, k AS execution_id FROM q WHERE k % 6 = 0 AND k % 12 <> 0
UNION ALL SELECT 'nested_loop_string_match', log_id, k FROM q WHERE k % 5 IN (2, 3)
UNION ALL SELECT 'outer_join_over', log_id, k FROM q WHERE k % 5 = 1 AND k % 3 = 0
UNION ALL SELECT 'uneven_shuffle', log_id, k FROM v
""")
def all_detectors_on_saved_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Several detectors over tables for which the text was read and parsed once."""
    names = ["dynamic_pruning", "nested_loop_string_match", "outer_join_over", "uneven_shuffle"]
    options = {"outer_join_over": {"child_name": "PartitionRecombination"}}
    found = detectors.run_detectors(_plans(spark, sf), names, save_to=scratch_path(spark, "events"), **options)
    return found.select("detector", "log_id", "execution_id")


# --- console output and findings -----------------------------------------------------------------------


@query("""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents)
SELECT doc_id, count(*) AS n, CAST(sum(length(value)) AS BIGINT) AS chars FROM l
WHERE regexp_matches(value, '[^\\x00-\\x20]') AND NOT (starts_with(value, 'End of LogType:stdout') OR starts_with(value, 'LogLength:') OR starts_with(value, '************************'))
GROUP BY doc_id
""")
def clean_console_output(spark: SparkSession, sf: str) -> DataFrame:
    """documents' lines with banners and blank lines put between them."""
    body = F.flatten(
        F.transform(
            F.split("text", "\n", -1),
            lambda line: F.array(F.lit("End of LogType:stdout"), line, F.lit(" \t"), F.lit("LogLength:7"), F.lit("*" * 40)),
        )
    )
    shown = samples.table(spark, sf, "documents").select("doc_id", F.explode(body).alias("value"))
    kept = console.clean_output(shown)
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).cast("bigint").alias("chars"))


@query(CONSOLE + "SELECT * FROM b")
def parse_finding_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks are small so that blocks and URLs cross them."""
    blocks = console.parse_findings(samples.console_lines(spark, sf), chunk_rows=64)
    return blocks.select("log_id", *_long("block_no"), "url", "sql")


@query(CONSOLE + "SELECT sql, arg_max(url, (log_id, block_no)) AS url, count(*) AS occurrences FROM b GROUP BY sql")
def unique_findings_by_sql(spark: SparkSession, sf: str) -> DataFrame:
    """O45."""
    return findings.unique_by_sql(console.parse_findings(samples.console_lines(spark, sf)))


@query(EVENTS + "SELECT DISTINCT log_id, 'metric ' || k % 30 AS message FROM e WHERE event_type = 'error'")
def dedup_messages(spark: SparkSession, sf: str) -> DataFrame:
    """O46."""
    updates = context.driver_metric_updates(_context(spark, sf))
    said = updates.select("log_id", F.concat(F.lit("metric "), F.col("accumulator_id")).alias("message"))
    return findings.dedup_messages(said)


@query(PLANS + """
SELECT 'dynamic_pruning' AS detector, q.log_id, k AS execution_id, url, sql FROM q WHERE k % 6 = 0 AND k % 12 <> 0
""")
def save_and_read_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The same findings given twice are saved once."""
    path = scratch_path(spark, "findings")
    found = detectors.dynamic_pruning(_plans(spark, sf), BASE_URL)
    save_findings(found.unionByName(found), path)
    return read_findings(spark, path).select("detector", "log_id", "execution_id", "url", "sql")


@query("""
SELECT 'orders_by_status' AS "table", count(DISTINCT o_orderstatus) AS n_folders, false AS missing FROM orders
UNION ALL SELECT 'orders_gone', 0, true
""")
def audit_table_storage(spark: SparkSession, sf: str) -> DataFrame:
    """A table with one folder per order status, and a table whose folder does not exist."""
    root = scratch_path(spark, "warehouse")
    samples.table(spark, sf, "orders").write.partitionBy("o_orderstatus").parquet(f"{root}/orders_by_status")
    name = "audit_" + root[-8:]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{root}'")
    for table in ("orders_by_status", "orders_gone"):
        spark.sql(f"CREATE TABLE {name}.{table} (o_orderkey BIGINT) USING parquet LOCATION '{root}/{table}'")
    return table_audit.audit_tables(spark, [name]).select("table", "n_folders", "missing")


@query("""
WITH o AS (
  SELECT CASE o_orderkey % 8 WHEN 0 THEN 'plain' WHEN 1 THEN 'outer' WHEN 2 THEN 'inner' WHEN 3 THEN 'away' WHEN 4 THEN 'parts' WHEN 5 THEN 'parts' END AS "table",
         o_orderkey % 8 AS place, length(CAST(o_orderkey AS VARCHAR)) + 1 AS size FROM orders),
f AS (SELECT "table", place, ceil(count(*) / 100.0) AS n_files, sum(size) AS bytes FROM o WHERE "table" IS NOT NULL GROUP BY ALL)
SELECT "table", count(*) AS n_folders, CAST(sum(n_files) AS BIGINT) AS n_files, CAST(sum(bytes) AS BIGINT) AS bytes, true AS has_newest, false AS missing FROM f GROUP BY ALL
UNION ALL SELECT 'bare', 0, 0, 0, false, false UNION ALL SELECT 'gone', 0, 0, 0, false, true
""")
def audit_table_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files, bytes and times of a table of the default database, one in the folder of another, one outside of its database's
    folder, one with a partition elsewhere, one with an empty folder and one with none."""
    root = scratch_path(spark, "warehouse")
    name = "audit_" + root[-8:]
    places = {"plain": "plain", "outer": "db/outer", "inner": "db/outer/inner", "away": "away", "parts": "db/parts/p=0", "other": "elsewhere"}
    orders = samples.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 8).alias("place"))
    numbered = running(orders.filter(F.col("place") < len(places)), "place", "o_orderkey", total={"no": F.lit(1)})
    numbered = stash(numbered.select("place", "no", F.col("o_orderkey").cast("string").alias("value")), "numbered")
    for k, place in enumerate(places.values()):
        _write_files(numbered.filter(F.col("place") == k), f"{root}/{place}", 100)
    numbered.select("value").limit(0).write.text(f"{root}/db/bare")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{root}/db'")
    for table in ("outer", "inner", "away", "bare", "gone"):
        spark.sql(f"CREATE TABLE {name}.{table} (value STRING) USING text LOCATION '{root}/{places.get(table, f'db/{table}')}'")
    spark.sql(f"CREATE TABLE default.{name}_plain (value STRING) USING text LOCATION '{root}/plain'")
    spark.sql(f"CREATE TABLE {name}.parts (value STRING, p INT) USING text PARTITIONED BY (p) LOCATION '{root}/db/parts'")
    spark.sql(f"ALTER TABLE {name}.parts ADD PARTITION (p = 0) PARTITION (p = 1) LOCATION '{root}/elsewhere'")
    found = table_audit.audit_tables(spark, ["default", name])
    # What the audit gives is stored already.
    spark.sql(f"DROP TABLE default.{name}_plain")
    spark.sql(f"DROP DATABASE {name} CASCADE")
    plain = F.when(F.col("db") == "default", F.regexp_extract("table", f"^{name}_(.*)$", 1)).otherwise(F.col("table"))
    shown = found.withColumn("table", plain).filter("table <> ''").withColumn("has_newest", F.col("newest").isNotNull())
    return shown.select("table", *_long("n_folders", "n_files", "bytes"), "has_newest", "missing")


# --- comparing runs ------------------------------------------------------------------------------------


@query(RUNS + "SELECT * FROM md")
def median_of_runs(spark: SparkSession, sf: str) -> DataFrame:
    """O47."""
    return compare.median_runs(samples.plan_runs(spark, sf))


@query(RUNS + "SELECT run_no, 'Scan a#1 Filter a#' || CASE WHEN run_no % 3 = run_no % 2 THEN 1 ELSE 2 END AS plan FROM r")
def normalize_plan_ids(spark: SparkSession, sf: str) -> DataFrame:
    """O49."""
    return samples.plan_runs(spark, sf).select("run_no", text.normalize_ids(F.col("plan")).alias("plan"))


@query(RUNS + "SELECT * FROM ch")
def plan_changed(spark: SparkSession, sf: str) -> DataFrame:
    """O50."""
    return compare.plan_changes(samples.plan_runs(spark, sf), "F", "O")


@query(RUNS + """
SELECT query, f.elapsed_ms AS elapsed_a, o.elapsed_ms AS elapsed_b, changed
FROM ch JOIN md f USING (query) JOIN md o USING (query) WHERE f.variant = 'F' AND o.variant = 'O'
""")
def compare_variants(spark: SparkSession, sf: str) -> DataFrame:
    """O51."""
    return compare.comparison(samples.plan_runs(spark, sf), "F", "O")


# Quotes are spelled chr(39), which both dialects read alike.
STATEMENT = """concat('select  * from t', o_orderkey % 2, ' where k = ', o_orderkey % 7, ' and s = ', chr(39), o_orderstatus,
 chr(39), ' and p > ', o_orderkey % 3, '.5 and d = ', o_orderkey % 4, 'L and e < ', o_orderkey % 5, '.5E', o_orderkey % 3, ' and f = ', chr(39), 'it',
 chr(92), chr(39), 's ', o_orderkey % 3, chr(39), ' -- it', chr(39), 's ', o_orderkey % 8, chr(10), ' and `c 7` = ', o_orderkey % 9, 'e2 /* ', o_orderkey, ' */')"""


@query(f"""
WITH s AS (
  SELECT {STATEMENT} AS sql, CAST(floor(o_totalprice) AS BIGINT) AS ms,
         concat('select * from t', o_orderkey % 2, ' where k = 0 and s = '''' and p > 0.0 and d = ', o_orderkey % 4, 'L and e < 0.0 and f = '''' and `c 7` = 0.0') AS text FROM orders)
SELECT md5(text) AS fingerprint, text, count(*) AS n, CAST(sum(ms) AS BIGINT) AS total_ms, min(sql) AS example FROM s GROUP BY text
""")
def literal_free_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Statements that differ in literals and comments meet; those that differ in table or Long literal do not."""
    executions = samples.table(spark, sf, "orders").select(
        F.expr(STATEMENT).alias("sql"), F.floor("o_totalprice").cast("bigint").alias("duration_ms")
    )
    return compare.similar_queries(executions)
