"""Names and fields of the listener events the engine reads (fixed values of the log format)."""

from __future__ import annotations

SQL_UI = "org.apache.spark.sql.execution.ui."

APPLICATION_START = "SparkListenerApplicationStart"
JOB_START = "SparkListenerJobStart"
STAGE_COMPLETED = "SparkListenerStageCompleted"
TASK_END = "SparkListenerTaskEnd"
SQL_START = SQL_UI + "SparkListenerSQLExecutionStart"
SQL_END = SQL_UI + "SparkListenerSQLExecutionEnd"
DRIVER_METRICS = SQL_UI + "SparkListenerDriverAccumUpdates"
PLAN_UPDATE = SQL_UI + "SparkListenerSQLAdaptiveExecutionUpdate"

# The set read by every analysis unless it asks for something else.
COMMON_EVENT_TYPES = (
    APPLICATION_START,
    SQL_START,
    SQL_END,
    JOB_START,
    STAGE_COMPLETED,
    DRIVER_METRICS,
    PLAN_UPDATE,
)

# Short kind -> (event tag, the fields used and their types). Only used fields are listed, so the JSON
# reader skips everything else, notably the textual plan description that repeats each plan. A field
# means the same in every kind that has it, so several kinds can be decoded together.
_ACCUMULABLES = "ARRAY<STRUCT<ID: BIGINT, Name: STRING, Value: STRING>>"
_PLAN_HEAD = "STRUCT<nodeName: STRING, simpleString: STRING>"
KINDS = {
    "app": (
        APPLICATION_START,
        {"App ID": "STRING", "App Attempt ID": "STRING", "App Name": "STRING", "Timestamp": "BIGINT"},
    ),
    "sql_start": (
        SQL_START,
        {"executionId": "BIGINT", "description": "STRING", "time": "BIGINT", "sparkPlanInfo": _PLAN_HEAD},
    ),
    "sql_end": (SQL_END, {"executionId": "BIGINT", "time": "BIGINT"}),
    "job": (
        JOB_START,
        {"Job ID": "BIGINT", "Properties": "STRUCT<`spark.sql.execution.id`: STRING, `spark.jobGroup.id`: STRING>"},
    ),
    "stage": (
        STAGE_COMPLETED,
        {"Stage Info": f"STRUCT<`Stage ID`: BIGINT, `Stage Attempt ID`: BIGINT, Accumulables: {_ACCUMULABLES}>"},
    ),
    "driver": (DRIVER_METRICS, {"executionId": "BIGINT", "accumUpdates": "ARRAY<ARRAY<BIGINT>>"}),
    "plan": (PLAN_UPDATE, {"executionId": "BIGINT", "sparkPlanInfo": _PLAN_HEAD}),
    "task": (
        TASK_END,
        {
            "Stage ID": "BIGINT",
            "Stage Attempt ID": "BIGINT",
            "Task End Reason": "STRUCT<Reason: STRING>",
            "Task Info": "STRUCT<`Task ID`: BIGINT, `Launch Time`: BIGINT, `Getting Result Time`: BIGINT, "
            "`Finish Time`: BIGINT, `Executor ID`: STRING, Host: STRING>",
            "Task Metrics": "STRUCT<`Executor Deserialize Time`: BIGINT, `Executor Run Time`: BIGINT, "
            "`Result Serialization Time`: BIGINT, `JVM GC Time`: BIGINT, `Result Size`: BIGINT>",
        },
    ),
}

# Node names that differ between Spark versions: old and new spelling.
SHUFFLE_READERS = ("CustomShuffleReader", "AQEShuffleRead")
COALESCED_READER_TEXTS = ("CustomShuffleReader coalesced", "AQEShuffleRead coalesced")
SORT_MERGE_JOINS = ("SortMergeJoin",)
SORT_MERGE_JOINS_WITH_SKEW = ("SortMergeJoin", "SortMergeJoin(skew=true)")
POSITION_CALLS = ("position(", "locate(")
FINAL_PLAN_TEXT = "AdaptiveSparkPlan isFinalPlan=true"
# What the line of every final plan contains.
FINAL_PLAN_WORD = "isFinalPlan=true"

HASH_EXCHANGE = "Exchange hashpartitioning"
# Texts that the detectors look for in nodes, by the name under which a plan's signature says whether it has them.
PLAN_MARKS = {
    "dynamic_pruning": "SubqueryBroadcast dynamicpruning",
    "nested_loop": "BroadcastNestedLoopJoin",
    "like": " LIKE ",
    "position": "position(",
    "locate": "locate(",
    "sort_merge": "SortMergeJoin",
    "coalesced": " coalesced",
    "left_outer": "LeftOuter",
    "right_outer": "RightOuter",
    "inner": "Inner",
}

ROWS_METRIC = "number of output rows"
PARTITIONS_METRIC = "number of partitions"
