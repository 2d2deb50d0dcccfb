import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import LINES_SCHEMA, app, driver, end, job, node, stage, start, task, update
from plansieve import events as ev
from plansieve.operators import context
from plansieve.operators.ordered import running
from plansieve.sources.decode import EventTables, corrupt_lines, decode_all
from plansieve.sources.lines import filter_event_types, search_lines


def test_bad_lines_do_not_stop_good_ones(spark, log):
    broken = json.dumps(start(7), separators=(",", ":"))[:-5]
    listed = [app(), "junk", "", ' {"Event":"SparkListenerJobStart"}', broken, start(1), '{"Event":"Unknown","x":1}', '{"Event":"no end']
    tables = log(a=listed)
    assert [r.executionId for r in tables.of("sql_start").collect()] == [1]
    bad = {int(r.ord): r.reason for r in tables.corrupt().collect()}
    assert bad == {1: "no event tag", 2: "no event tag", 3: "no event tag", 4: "broken json", 7: "no event tag"}


def test_event_type_filter(spark, log):
    lines = log(a=[app(), start(1), '{"Event":"Unknown"}', '{"Event":""}', "x"])._lines
    assert filter_event_types(lines).count() == 2
    assert filter_event_types(lines, []).count() == 4
    assert filter_event_types(lines, ["Unknown"]).count() == 1


def test_search_is_distinct_per_log(spark, log):
    lines = log(a=[start(1), start(1), start(2)], b=[start(1)])._lines
    assert search_lines(lines, '"executionId":1,').count() == 2


def test_last_metric_value_wins(spark, log):
    tables = log(
        a=[
            driver(1, (5, 10), (6, 1), (6, 2)),
            stage({"ID": 5, "Name": "n", "Value": "11"}, {"ID": 7, "Name": "n", "Value": "List([a])"}, {"ID": 8, "Name": "none"}),
            driver(1, (9, 90)),
            stage({"ID": 9, "Name": "internal", "Value": 91}, {"ID": 10, "Name": "n", "Value": " 12"}, {"ID": 11, "Name": "n", "Value": "-3"}),
        ],
        b=[driver(1, (5, 99))],
    )
    found = {(r.log_id, r.accumulator_id): r.value for r in context.metrics(tables).collect()}
    assert found == {("a", 5): 11, ("a", 6): 2, ("a", 7): 0, ("a", 9): 91, ("a", 10): 0, ("a", 11): -3, ("b", 5): 99}


def test_metric_lookup_defaults(spark, log):
    metrics = context.metrics(log(a=[driver(1, (5, 10))]))
    rows = spark.createDataFrame(
        [("a", Decimal(0), 0, 5), ("a", Decimal(0), 1, 6), ("a", Decimal(0), 2, None), ("b", Decimal(0), 3, 5)],
        "log_id STRING, ord DECIMAL(38,0), node_no INT, id BIGINT",
    )
    found = {r.node_no: r.value for r in context.lookup_metric(rows, "id", metrics, "value").collect()}
    assert found == {0: 10, 1: -1, 2: None, 3: -1}


def test_executions(spark, log):
    tables = log(
        a=[
            job(1, "early"), start(1, "one", 100), job(1, "g1"), job(1, "g2"), end(1, 400),
            start(2, "two", 200),
            end(3, 300),
            start(0, "zero", 1), end(0, 2), start(0, "zero again", 5), job(0, None), job(None, "g"), job("x", "g"),
        ],
        b=[start(1, "other log", 7), end(1, 8)],
    )
    found = {(r.log_id, r.execution_id): (r.query_id, r.sql, r.start_ms, r.end_ms, r.duration_ms) for r in context.sql_executions(tables).collect()}
    assert found == {
        ("a", 1): ("g2", "one", 100, 400, 300),
        ("a", 2): (None, "two", 200, None, None),
        ("a", 0): (None, "zero again", 5, None, None),
        ("b", 1): (None, "other log", 7, 8, 1),
    }


def test_applications(spark, log):
    no_id = app()
    del no_id["App ID"]
    tables = log(a=[app("x", "1"), app("y"), no_id], b=[no_id])
    found = {r.log_id: (r.app_id, r.attempt_id) for r in context.applications(tables).collect()}
    assert found == {"a": ("y", ""), "b": (None, None)}


def test_current_execution(spark, log):
    d = lambda i: driver(0, (i, i))
    tables = log(a=[d(0), start(0), d(1), start(4), d(2), end(0), d(3), start(5), d(4)], b=[d(5)])
    events = tables.of("driver").select("log_id", "ord", F.col("accumUpdates")[0][0].alias("i"))
    for chunk_rows in (1, 3, 100):
        found = {r.i: r.current_execution_id for r in context.attribute_to_execution(events, tables, chunk_rows).collect()}
        assert found == {0: None, 1: 0, 2: 4, 3: None, 4: 5, 5: None}


def test_running_matches_plain_loop_on_a_hot_key(spark):
    rng = random.Random(3)
    rows = []
    for key, n in (("hot", 700), ("b", 40), ("c", 1)):
        places = sorted(rng.sample(range(5000), n))
        rows += [(key, Decimal(p), rng.choice([None, rng.randrange(9)]), rng.randrange(5)) for p in places]
    df = spark.createDataFrame(rows, "key STRING, ord DECIMAL(38,0), mark BIGINT, n BIGINT")
    want, last, total = {}, {}, {}
    for key, place, mark, n in rows:
        last[key] = mark if mark is not None else last.get(key)
        total[key] = total.get(key, 0) + n
        want[key, place] = (last[key], total[key])
    out = running(df, "key", last={"l": F.col("mark")}, total={"t": F.col("n")}, chunk_rows=50)
    assert {(r.key, r.ord): (r.l, r.t) for r in out.collect()} == want


def test_saved_tables_answer_like_text(spark, log, tmp_path):
    tables = log(
        a=[app("x", "1"), start(1, "one", 100, node("Scan", "Scan t")), job(1, "g"), update(1, node("P", "P", [node("Q")])), driver(1, (1, 2)),
           stage({"ID": 2, "Name": "n", "Value": "3"}), end(1, 200), '{"Event":"SparkListenerJobStart","Job ID":', "junk"],
        b=[start(2)],
    )
    path = str(tmp_path / "events")
    tables.save(path)
    saved = EventTables.open(spark, path)
    for kind in ev.KINDS:
        assert sorted(map(str, tables.of(kind).collect())) == sorted(map(str, saved.of(kind).collect())), kind
    for fn in (context.applications, context.sql_executions, context.metrics):
        assert sorted(map(str, fn(tables).collect())) == sorted(map(str, fn(saved).collect()))
    assert sorted(map(str, saved.corrupt().collect())) == sorted(map(str, tables.corrupt().collect()))
    assert saved.plans("plan").first().nodes[0].node_no == 0
    assert corrupt_lines(tables._lines).count() == 2


def test_kinds_that_were_not_saved_are_told_or_read_from_the_text(spark, log, tmp_path):
    tables = log(a=[app("x"), start(1), task()])
    saved = tables.save(str(tmp_path / "some"), ["app", "sql_start"])
    with pytest.raises(ValueError, match="task"):
        saved.of("task")
    assert tables.once().of("task").count() == 1


def test_saved_tables_of_no_lines_open_again(spark, log, tmp_path):
    path = str(tmp_path / "none")
    log(a=[app("x")]).save(path + "-some")
    EventTables.from_lines(spark.createDataFrame([], LINES_SCHEMA)).save(path)
    opened = EventTables.open(spark, path)
    assert opened.of("plan", "sql_start").count() == 0 and opened.plans("plan").count() == 0 and opened.corrupt().count() == 0


def test_few_executions_are_picked_before_they_are_gathered(spark, log):
    tables = log(a=[app(), start(1, "one", 1000), job(1, "g"), end(1, 1500), start(2, "two", 1000), end(2, 2500), end(3, 9)])
    needed = spark.createDataFrame([("a", 2), ("a", 3), ("b", 1)], "log_id STRING, execution_id BIGINT")
    found = context.sql_executions(tables, needed)
    assert [(r.execution_id, r.sql, r.duration_ms) for r in found.collect()] == [(2, "two", 1500)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # An operator's inputs are printed below it.
    assert plan.index("Aggregate [log_id") < plan.index("Join LeftSemi")


def test_metrics_of_saved_tables_are_those_of_the_text(log):
    def acc(number, value):
        return {"ID": number, "Name": "n"} | ({} if value is None else {"Value": value})

    lists = [
        [acc(1, "1"), acc(2, "2")],
        [acc(1, "3"), acc(1, "4"), acc(2, None)],
        [acc(5, "6"), acc(5, None)],
        [acc(7, "x"), acc(8, " 9")],
        [],
    ]
    tables = log(a=[app(), *[stage(*a) for a in lists], driver(1, (9, 1), (9, 2), (10, 3)), driver(1, (1, 8)), driver(1)], b=[app(), stage(*lists[0])])
    rows = sorted(context.metrics(tables).collect())
    assert rows == sorted(context.metrics(tables.once()).collect())
    assert {(r.accumulator_id, r.value) for r in rows if r.log_id == "a"} == {(1, 8), (2, 2), (5, 6), (7, 0), (8, 0), (9, 2), (10, 3)}


def test_lines_of_tables_for_words(spark):
    lines = [None, "no tag", '{"Event":"SparkListenerApplicationStartX","App ID":"x"}', '{"Event":"SparkListenerApplicationStart","App ID":"x"}', '{"Event":"SparkListenerApplicationStart']
    rows = spark.createDataFrame([("a", Decimal(i), x) for i, x in enumerate(lines)], LINES_SCHEMA)
    found = decode_all(rows, ["app", "plan"], ("Join",)).select("ord", "kind", "reason").collect()
    assert sorted((int(r.ord), r.kind, r.reason) for r in found) == [
        (0, "corrupt", "no event tag"), (1, "corrupt", "no event tag"), (3, "app", None), (4, "corrupt", "no event tag")
    ]
