"""Event-log lines derived from the test tables, as the log reader would deliver them.

Each builder turns the rows of a table into (log_id, ord, value) lines of event-log JSON inside Spark, so the
operators decode real text while their answers can be worked out from the table's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansieve.events import (
    APPLICATION_START,
    DRIVER_METRICS,
    JOB_START,
    PLAN_UPDATE,
    SQL_END,
    SQL_START,
    STAGE_COMPLETED,
    TASK_END,
)

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Text in a task, as a file's block would have it.
BLOCK_BYTES = 64 << 20


def _spread(rows: DataFrame, text_bytes: int) -> DataFrame:
    """As many tasks as the log text would have blocks, and all cores at least: rows grow manyfold when they become text.

    ``text_bytes`` is about what one row becomes.
    """
    blocks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * text_bytes // BLOCK_BYTES))
    return rows.repartition(blocks) if rows.rdd.getNumPartitions() < blocks else rows


def _sql(template: str) -> Column:
    return F.expr(template)


def _text(template: str, **columns: str) -> str:
    """SQL that fills ``<name>`` places of a JSON template with columns cast to text."""
    pieces, rest = [], template
    while rest:
        before, opened, after = rest.partition("<<")
        if before:
            pieces.append("'" + before.replace("'", "\\'") + "'")
        if not opened:
            break
        name, _, rest = after.partition(">>")
        pieces.append(f"CAST(({columns.get(name, name)}) AS STRING)")
    return f"concat({', '.join(pieces)})"


def _opaque(value: Column) -> Column:
    """Line text as a generator's output: filters then see text that is built once, as they would in a file."""
    return F.explode(F.array(value)).alias("value")


def _application_lines(keys: DataFrame, key: str) -> DataFrame:
    """One application-start line per distinct key; odd keys have an attempt id."""
    head = f'{{"Event":"{APPLICATION_START}","App Name":"app <<k>>","App ID":"application_<<k>>",'
    with_attempt = _text(head + '"App Attempt ID":"1","Timestamp":<<k>>,"User":"u"}', k=key)
    without = _text(head + '"Timestamp":<<k>>,"User":"u"}', k=key)
    return (
        keys.select(key)
        .distinct()
        .select(
            F.concat(F.lit("application_"), F.col(key)).alias("log_id"),
            F.lit(-1).cast("decimal(38,0)").alias("ord"),
            _opaque(_sql(f"CASE WHEN {key} % 2 = 1 THEN {with_attempt} ELSE {without} END")),
        )
    )


def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per user; each event becomes one line in order of its id.

    With k the number in ``props``: signup starts and purchase ends execution k % 5, click starts a job of
    execution k % 5 and group k, error posts metric k % 30 from the driver, view completes a stage with
    metric k % 30 (text where k % 10 = 0, no value where k % 10 = 1).
    """
    events = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.expr(f"timestampdiff(MILLISECOND, {EPOCH}, ts)").alias("ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    start = _text(
        f'{{"Event":"{SQL_START}","executionId":<<k % 5>>,"description":"q <<k>>","details":"",'
        '"physicalPlanDescription":"","sparkPlanInfo":{"nodeName":"Scan","simpleString":"Scan","children":[],'
        '"metadata":{},"metrics":[]},"time":<<ms>>}'
    )
    end = _text(f'{{"Event":"{SQL_END}","executionId":<<k % 5>>,"time":<<ms>>,"errorMessage":""}}')
    job = _text(
        f'{{"Event":"{JOB_START}","Job ID":<<event_id>>,"Submission Time":<<ms>>,"Stage Infos":[],"Stage IDs":[],'
        '"Properties":{"spark.sql.execution.id":"<<k % 5>>","spark.jobGroup.id":"g<<k>>"}}'
    )
    driver = _text(
        f'{{"Event":"{DRIVER_METRICS}","executionId":<<k % 5>>,"accumUpdates":[[<<k % 30>>,<<event_id>>]]}}'
    )
    head = f'{{"Event":"{STAGE_COMPLETED}","Stage Info":{{"Stage ID":<<k>>,"Stage Attempt ID":0,"Accumulables":['
    stage_number = _text(head + '{"ID":<<k % 30>>,"Name":"m","Value":"<<event_id>>"}]}}')
    stage_text = _text(head + '{"ID":<<k % 30>>,"Name":"m","Value":"List([a])"}]}}')
    stage_none = _text(head + '{"ID":<<k % 30>>,"Name":"m"}]}}')
    value = f"""CASE event_type WHEN 'signup' THEN {start} WHEN 'purchase' THEN {end} WHEN 'click' THEN {job}
        WHEN 'error' THEN {driver} WHEN 'view' THEN
        CASE k % 10 WHEN 0 THEN {stage_text} WHEN 1 THEN {stage_none} ELSE {stage_number} END END"""
    lines = _spread(events, 300).select(
        F.concat(F.lit("application_"), F.col("user_id")).alias("log_id"),
        F.col("event_id").cast("decimal(38,0)").alias("ord"),
        _opaque(_sql(value)),
    )
    return lines.unionByName(_application_lines(events, "user_id"))


def task_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per supplier; each line item is a finished task, a failed one where it was returned ('R')."""
    tasks = table(spark, sf_dir, "lineitem").select(
        "*",
        F.expr(f"timestampdiff(MILLISECOND, {EPOCH}, l_shipdate)").alias("launch"),
        F.expr("CAST(l_quantity * 1000 AS BIGINT)").alias("run"),
    )
    value = _text(
        f'{{"Event":"{TASK_END}","Stage ID":<<l_orderkey>>,"Stage Attempt ID":<<l_linenumber>>,"Task Type":"ResultTask",'
        '"Task End Reason":{"Reason":"<<reason>>"},"Task Info":{"Task ID":<<l_partkey>>,"Launch Time":<<launch>>,'
        '"Executor ID":"<<l_suppkey % 7>>","Host":"h<<l_suppkey % 3>>","Getting Result Time":<<got>>,'
        '"Finish Time":<<done>>},"Task Metrics":{"Executor Deserialize Time":<<l_partkey % 10>>,'
        '"Executor Run Time":<<run>>,"Result Serialization Time":1,"JVM GC Time":2,"Result Size":<<l_partkey>>}}',
        reason="CASE WHEN l_returnflag = 'R' THEN 'TaskKilled' ELSE 'Success' END",
        done="launch + l_partkey * 100",
        got="CASE WHEN l_linenumber % 2 = 0 THEN launch + l_partkey * 100 - 50 ELSE 0 END",
    )
    lines = _spread(tasks, 500).select(
        F.concat(F.lit("application_"), F.col("l_suppkey")).alias("log_id"),
        F.col("l_orderkey").cast("decimal(38,0)").alias("ord"),
        _opaque(_sql(value)),
    )
    return lines.unionByName(_application_lines(tasks, "l_suppkey"))


def _node(name: str, text: str, metrics: list[tuple[str, str]] | str, children: list[str]) -> str:
    """SQL for one plan node's JSON; ``children`` are SQL texts, empty ones of which vanish."""
    if isinstance(metrics, str):
        listed = metrics
    else:
        listed = "'" + ",".join(f'{{"name":"{n}","accumulatorId":\', {i}, \',"metricType":"sum"}}' for n, i in metrics) + "'"
    kids = f"concat_ws(',', {', '.join(children)})" if children else "''"
    return (
        f"""concat('{{"nodeName":"', {name}, '","simpleString":"', {text}, '","children":[', {kids}, """
        f"""'],"metadata":{{}},"metrics":[', {listed}, ']}}')"""
    )


def _input(shuffle: str, exchange_id: str, reader_id: str, side: str, scan: str) -> str:
    """SQL for a join input: scan below an exchange (0), a reader over an exchange (1) or a broadcast (2)."""
    exchange = _node(
        "'Exchange'",
        f"concat('Exchange hashpartitioning({side}#', o_orderkey, 'L, ', 10 + o_orderkey % 3, '), ENSURE_REQUIREMENTS, [plan_id=', o_orderkey, ']')",
        [("data size", exchange_id)],
        [scan],
    )
    reader = _node(
        "'AQEShuffleRead'",
        "'AQEShuffleRead coalesced'",
        f"""CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('{{"name":"number of partitions","accumulatorId":', {reader_id}, ',"metricType":"sum"}}') END""",
        [exchange],
    )
    broadcast = _node("'BroadcastExchange'", "'BroadcastExchange HashedRelationBroadcastMode'", [], [scan])
    return f"CASE {shuffle} WHEN 0 THEN {exchange} WHEN 1 THEN {reader} ELSE {broadcast} END"


# Join nodes of the sample plans by o_orderkey % 5: node name and text.
JOINS = [
    ("SortMergeJoin", "SortMergeJoin [a#1], [b#2], Inner"),
    ("SortMergeJoin", "SortMergeJoin [a#1L], [b#2L, c#3], LeftOuter"),
    ("BroadcastNestedLoopJoin", "BroadcastNestedLoopJoin BuildRight, Inner, name#3 LIKE x#4"),
    ("BroadcastNestedLoopJoin", "BroadcastNestedLoopJoin BuildRight, Inner, (locate(x#1, y#2, 1) > 0)"),
    ("BroadcastHashJoin", "BroadcastHashJoin [a#1L], [b#2L], Inner, BuildRight, false"),
]


def plan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per customer and one execution with one plan update per order.

    With k the order key and c the customer key, a plan reads top down::

        AdaptiveSparkPlan, final where k % 2 = 0
          Filter with a row metric where k % 4 >= 2, then Projects, k % 4 such nodes in all
            join of kind k % 5
              PartitionRecombination where k % 3 = 0, else Sort, over an input of kind c % 3
              HashAggregate over an input of kind (c div 3) % 3
          where k % 6 = 0 a SubqueryBroadcast, a dynamic-pruning one unless k % 12 = 0

    Metric ids are 16 k + a slot; values follow the update, partly from the driver, partly from a stage.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.expr("CAST(floor(o_totalprice) AS BIGINT)").alias("left_rows"),
        F.expr(f"timestampdiff(MILLISECOND, {EPOCH}, o_orderdate)").alias("ms"),
    )

    def slot(n: int) -> str:
        return f"o_orderkey * 16 + {n}"

    def rows(n: int) -> list[tuple[str, str]]:
        return [("number of output rows", slot(n))]

    scans = {
        n: _node("'Scan parquet '", f"'FileScan parquet db1.{name}[a#1L,b#2] Batched: true'", rows(n), [])
        for n, name in ((4, "left_t"), (8, "right_t"))
    }
    left = _node(
        "CASE WHEN o_orderkey % 3 = 0 THEN 'PartitionRecombination' ELSE 'Sort' END",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'PartitionRecombination' ELSE 'Sort [a#1L ASC]' END",
        [],
        [_input("o_custkey % 3", slot(3), slot(2), "a", scans[4])],
    )
    right = _node(
        "'HashAggregate'", "'HashAggregate(keys=[b#2], functions=[])'", rows(5),
        [_input("(o_custkey DIV 3) % 3", slot(7), slot(6), "b", scans[8])],
    )
    cases = " ".join(f"WHEN {i} THEN '{{}}'" for i in range(5))
    join = _node(
        f"CASE o_orderkey % 5 {cases.format(*[n for n, _ in JOINS])} END",
        f"CASE o_orderkey % 5 {cases.format(*[t for _, t in JOINS])} END",
        rows(1),
        [left, right],
    )
    project = '{"nodeName":"Project","simpleString":"Project [a#1L]","children":['
    project_end = '],"metadata":{},"metrics":[]}'
    # The steps above the join are one-child nodes, so they can be written as a prefix and a suffix.
    filtered = "o_orderkey % 4 >= 2"
    projects = f"CAST(o_orderkey % 4 - CASE WHEN {filtered} THEN 1 ELSE 0 END AS INT)"
    opening = f"""concat(CASE WHEN {filtered} THEN '{{"nodeName":"Filter","simpleString":"Filter (a#1L > 0)","children":[' ELSE '' END,
        repeat('{project}', {projects}))"""
    closing = f"""concat(repeat('{project_end}', {projects}), CASE WHEN {filtered} THEN
        concat('],"metadata":{{}},"metrics":[{{"name":"number of output rows","accumulatorId":', {slot(9)}, ',"metricType":"sum"}}]}}') ELSE '' END)"""
    pruning = _node(
        "'SubqueryBroadcast'",
        "CASE WHEN o_orderkey % 12 = 0 THEN 'SubqueryBroadcast other#7' ELSE 'SubqueryBroadcast dynamicpruning#7, 0' END",
        [], [],
    )
    root = _node(
        "'AdaptiveSparkPlan'",
        "concat('AdaptiveSparkPlan isFinalPlan=', CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END)",
        [],
        [f"concat({opening}, {join}, {closing})", f"CASE WHEN o_orderkey % 6 = 0 THEN {pruning} END"],
    )
    start = _text(
        f'{{"Event":"{SQL_START}","executionId":<<o_orderkey>>,"description":"select <<o_orderkey % 50>> from t",'
        '"details":"","physicalPlanDescription":"","sparkPlanInfo":{"nodeName":"Scan","simpleString":"Scan",'
        '"children":[],"metadata":{},"metrics":[]},"time":<<ms>>}'
    )
    job = _text(
        f'{{"Event":"{JOB_START}","Job ID":<<o_orderkey>>,"Submission Time":<<ms>>,"Stage Infos":[],"Stage IDs":[],'
        '"Properties":{"spark.sql.execution.id":"<<o_orderkey>>","spark.jobGroup.id":"g<<o_orderkey % 10>>"}}'
    )
    update = f"""concat('{{"Event":"{PLAN_UPDATE}","executionId":', o_orderkey,
        ',"physicalPlanDescription":"== Physical Plan ==","sparkPlanInfo":', {root}, '}}')"""
    values = {1: SAMPLE_VALUES["join"], 3: "1", 5: SAMPLE_VALUES["aggregate"], 7: "1", 9: SAMPLE_VALUES["filter"]}
    pairs = ",".join(f"[<<{slot(n)}>>,<<{v}>>]" for n, v in values.items())
    partitions = ",".join(f"[<<{slot(n)}>>,<<{SAMPLE_VALUES['partitions']}>>]" for n in (2, 6))
    driver_head = f'{{"Event":"{DRIVER_METRICS}","executionId":<<o_orderkey>>,"accumUpdates":['
    driver = f"""CASE WHEN o_orderkey % 11 = 0 THEN {_text(driver_head + pairs + ']}')}
        ELSE {_text(driver_head + pairs + ',' + partitions + ']}')} END"""
    stage = _text(
        f'{{"Event":"{STAGE_COMPLETED}","Stage Info":{{"Stage ID":1,"Stage Attempt ID":0,"Accumulables":['
        f'{{"ID":<<{slot(4)}>>,"Name":"rows","Value":"<<{SAMPLE_VALUES["left"]}>>"}},'
        f'{{"ID":<<{slot(8)}>>,"Name":"rows","Value":<<{SAMPLE_VALUES["right"]}>>}}]}}}}'
    )
    end = _text(f'{{"Event":"{SQL_END}","executionId":<<o_orderkey>>,"time":<<ms + o_orderkey % 97 * 1000 + 500>>,"errorMessage":""}}')
    lines = F.expr(
        f"""filter(array(
            struct(0 AS step, {start} AS value),
            struct(1 AS step, CASE WHEN o_orderkey % 9 <> 0 THEN {job} END AS value),
            struct(2 AS step, {update} AS value),
            struct(3 AS step, {driver} AS value),
            struct(4 AS step, {stage} AS value),
            struct(5 AS step, CASE WHEN o_orderkey % 13 <> 0 THEN {end} END AS value)
        ), x -> x.value IS NOT NULL)"""
    )
    logged = _spread(orders, 4000).select("o_orderkey", "o_custkey", F.inline(lines)).select(
        F.concat(F.lit("application_"), F.col("o_custkey")).alias("log_id"),
        (F.col("o_orderkey").cast("decimal(20,0)") * 10 + F.col("step")).cast("decimal(38,0)").alias("ord"),
        "value",
    )
    return logged.unionByName(_application_lines(orders, "o_custkey"))


# Row counts and partition counts of the sample plans, as SQL over an order's columns.
SAMPLE_VALUES = {
    "left": "left_rows",
    "aggregate": "o_custkey",
    "right": "o_custkey * (1 + o_orderkey % 4)",
    "join": "least(left_rows, o_custkey) + CASE WHEN o_orderkey % 7 = 1 THEN 1 ELSE 0 END",
    "filter": "least(left_rows, o_custkey) + CASE WHEN o_orderkey % 7 = 2 THEN 1 ELSE 0 END",
    "partitions": "10 + (o_orderkey DIV 3) % 3",
}


def plan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, variant, run_no, elapsed_ms, plan): each order is a run of its customer's query."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("query"),
        F.col("o_orderstatus").alias("variant"),
        F.col("o_orderkey").alias("run_no"),
        F.expr("CAST(floor(o_totalprice / 1000) AS BIGINT)").alias("elapsed_ms"),
        F.expr("concat('Scan a#', o_orderkey % 3, 'L Filter a#', o_orderkey % 2, 'L')").alias("plan"),
    )


def console_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of container output: one file per conversation, banners, URL and SQL blocks and noise.

    A user's turn is a URL block; an assistant's turn is a SQL block with its text; any other turn is
    text outside blocks.
    """
    turns = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", F.lit("URL")).when(F.col("role") == "assistant", F.lit("SQL"))
    text = F.when(F.col("role") == "user", F.concat(F.lit("http://h/"), F.col("conv_id"), F.lit("/"), F.col("turn"))).otherwise(
        F.col("text")
    )
    body = F.split(text, "\n", -1)
    lines = F.when(kind.isNull(), body).otherwise(
        F.concat(
            F.array(F.lit("LogLength:12"), F.lit(" "), F.concat(F.lit("__BLOCKSTART__"), kind)),
            body,
            F.array(F.concat(F.lit("__BLOCKEND__"), kind), F.lit("noise")),
        )
    )
    return turns.select("conv_id", "turn", F.posexplode(lines).alias("no", "value")).select(
        F.concat(F.lit("container_"), F.col("conv_id")).alias("log_id"),
        (F.col("turn").cast("decimal(20,0)") * 1_000_000 + F.col("no")).cast("decimal(38,0)").alias("ord"),
        "value",
    )
