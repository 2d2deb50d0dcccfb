import json
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plansieve import events as ev  # noqa: E402
from plansieve.session import build_session  # noqa: E402
from plansieve.sources.decode import EventTables  # noqa: E402

LINES_SCHEMA = "log_id STRING, ord DECIMAL(38,0), value STRING"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def log(spark):
    """Event tables of hand-written logs: ``log(a=[event, ...], b=[...])``; events are dicts or raw text."""

    def make(**logs):
        rows = [
            (log_id, Decimal(i), e if isinstance(e, str) else json.dumps(e, separators=(",", ":")))
            for log_id, listed in logs.items()
            for i, e in enumerate(listed)
        ]
        return EventTables.from_lines(spark.createDataFrame(rows, LINES_SCHEMA))

    return make


def app(app_id="application_1_1", attempt=None, time=1000):
    e = {"Event": ev.APPLICATION_START, "App Name": "a", "App ID": app_id, "Timestamp": time, "User": "u"}
    if attempt is not None:
        e["App Attempt ID"] = attempt
    return e


def start(execution, sql="select 1", time=2000, plan=None):
    return {
        "Event": ev.SQL_START, "executionId": execution, "description": sql, "details": "",
        "physicalPlanDescription": "", "sparkPlanInfo": plan or node("Scan"), "time": time,
    }


def end(execution, time=5000):
    return {"Event": ev.SQL_END, "executionId": execution, "time": time, "errorMessage": ""}


def job(execution, group, number=0):
    properties = {"other": "x"}
    if execution is not None:
        properties["spark.sql.execution.id"] = str(execution)
    if group is not None:
        properties["spark.jobGroup.id"] = group
    return {"Event": ev.JOB_START, "Job ID": number, "Submission Time": 1, "Stage Infos": [], "Stage IDs": [], "Properties": properties}


def driver(execution, *pairs):
    return {"Event": ev.DRIVER_METRICS, "executionId": execution, "accumUpdates": [list(p) for p in pairs]}


def stage(*accumulables):
    return {"Event": ev.STAGE_COMPLETED, "Stage Info": {"Stage ID": 0, "Stage Attempt ID": 0, "Accumulables": list(accumulables)}}


def node(name, text=None, children=(), **metrics):
    """A plan node; ``rows=7`` lists the row metric under id 7, ``partitions=8`` the partition metric."""
    names = {"rows": ev.ROWS_METRIC, "partitions": ev.PARTITIONS_METRIC}
    return {
        "nodeName": name, "simpleString": name if text is None else text, "children": list(children), "metadata": {},
        "metrics": [{"name": names[k], "accumulatorId": v, "metricType": "sum"} for k, v in metrics.items()],
    }


def update(execution, plan):
    return {"Event": ev.PLAN_UPDATE, "executionId": execution, "physicalPlanDescription": "", "sparkPlanInfo": plan}


def final(execution, *children):
    return update(execution, node("AdaptiveSparkPlan", ev.FINAL_PLAN_TEXT, children))


def task(stage_id=0, task_id=0, reason="Success", launch=1000, got=0, done=2000, deserialize=0, run=0, serialize=0):
    return {
        "Event": ev.TASK_END, "Stage ID": stage_id, "Stage Attempt ID": 0, "Task Type": "ResultTask",
        "Task End Reason": {"Reason": reason},
        "Task Info": {"Task ID": task_id, "Launch Time": launch, "Executor ID": "1", "Host": "h", "Getting Result Time": got, "Finish Time": done},
        "Task Metrics": {"Executor Deserialize Time": deserialize, "Executor Run Time": run, "Result Serialization Time": serialize, "JVM GC Time": 2, "Result Size": 99},
    }
