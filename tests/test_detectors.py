import pytest
from pyspark.sql import functions as F

from conftest import app, driver, end, final, job, node, start, task, update
from plansieve import events as ev
from plansieve.operators import detectors as d
from plansieve.operators.findings import as_findings
from plansieve.plans.tree import shuffles_below_inputs, plan_trees, plan_updates, uneven_joins
from plansieve.operators.context import metrics, sql_executions
from plansieve.operators.narrow import stash
from plansieve.plans import cost as costs


def smj(left, right, text="SortMergeJoin [a#1], [b#2], Inner", name="SortMergeJoin"):
    return node(name, text, [node("Sort", children=[left]), node("Sort", children=[right])])


def exchange(n, key="a#1"):
    return node("Exchange", f"Exchange hashpartitioning({key}, {n})", [node("Scan parquet ")])


def reader(partitions=None, n=200, name="AQEShuffleRead"):
    listed = {} if partitions is None else {"partitions": partitions}
    return node(name, f"{name} coalesced", [exchange(n, "b#2")], **listed)


@pytest.mark.parametrize(
    ("plan", "values", "hit"),
    [
        (smj(exchange(200), reader(5)), [(5, 20)], True),
        (smj(reader(5), exchange(200)), [(5, 20)], True),
        (smj(exchange(200), reader(5, name="CustomShuffleReader")), [(5, 20)], True),
        (smj(exchange(200), reader(5)), [(5, 200)], False),
        (smj(exchange(200), reader(None)), [], False),
        (smj(exchange(200), reader(5)), [], True),
        (smj(exchange(200), exchange(200)), [], False),
        (smj(node("BroadcastExchange", children=[exchange(200)]), reader(5)), [(5, 20)], False),
        (smj(node("Scan parquet x", children=[exchange(200)]), reader(5)), [(5, 20)], False),
        (smj(exchange(200), reader(5), name="SortMergeJoin(skew=true)"), [(5, 20)], False),
    ],
)
def test_uneven_shuffle(log, plan, values, hit):
    tables = log(a=[app(attempt="1"), start(1, "q"), driver(1, *values), update(1, plan), update(1, plan), end(1)])
    found = d.uneven_shuffle(tables, base_url="http://b").collect()
    assert [(r.detector, r.log_id, r.execution_id, r.url, r.sql) for r in found] == (
        [("uneven_shuffle", "a", 1, "http://b/application_1_1/1/SQL/execution/?id=1", "q")] if hit else []
    )
    if hit:
        assert found[0].detail == {"unclear": str(not values).lower()}


def test_uneven_shuffle_may_match_skew_joins(log):
    plan = smj(exchange(200), reader(5), name="SortMergeJoin(skew=true)")
    tables = log(a=[app(), start(1), driver(1, (5, 20)), update(1, plan)])
    assert d.uneven_shuffle(tables, parents=ev.SORT_MERGE_JOINS_WITH_SKEW).count() == 1
    reached = shuffles_below_inputs(plan_trees(plan_updates(tables)), ev.SORT_MERGE_JOINS_WITH_SKEW)
    assert uneven_joins(reached, metrics(tables)).first().partitions == 20


def test_nested_loop_string_match(log):
    def loop(text, name="BroadcastNestedLoopJoin"):
        return node("Project", children=[node(name, f"{name} BuildRight, Inner, {text}", [node("Scan"), node("Scan")])])

    tables = log(
        a=[
            app(), start(1, "q1", 1000), job(1, "g"), update(1, loop("a#1 LIKE b#2")), end(1, 4999),
            start(2, "q2", 1000), update(2, loop("(position(a#1, b#2) > 0)")), update(2, loop("(position(a#1, b#2) > 0)")),
            start(3, "q3", 1000), update(3, loop("(locate(a#1, b#2, 1) > 0)")), end(3, 2000),
            start(4), update(4, loop("a#1 = b#2")), start(5), update(5, loop("a#1 LIKE b#2", "BroadcastHashJoin")),
        ]
    )
    found = {r.execution_id: (r.kind, r.query_id, r.start_ms, r.end_ms, r.seconds, r.sql) for r in d.nested_loop_matches(tables).collect()}
    assert found == {
        1: ("LIKE", "g", 1000, 4999, 3, "q1"),
        2: ("POSITION", None, 1000, None, None, "q2"),
        3: ("POSITION", None, 1000, 2000, 1, "q3"),
    }
    assert d.nested_loop_string_match(tables).filter(F.col("execution_id") == 1).first().detail["seconds"] == "3"


def test_node_search_pruning_and_outer_join(log):
    named = node("PartitionRecombination", children=[node("Scan")])

    def outer(kind, left, right):
        return node("SortMergeJoin", f"SortMergeJoin [a#1], [b#2], {kind}", [left, right])

    tables = log(
        a=[
            app(), start(1, "one"), update(1, outer("LeftOuter", named, node("Scan"))), update(1, outer("LeftOuter", named, node("Scan"))),
            start(2), update(2, outer("LeftOuter", node("Scan"), named)),
            start(3), update(3, node("Union", children=[outer("RightOuter", node("Scan"), named)])),
            start(4), update(4, outer("LeftOuter", node("Sort", children=[named]), node("Scan"))),
            start(5), update(5, node("SubqueryBroadcast", "SubqueryBroadcast dynamicpruning#7")),
            start(6), update(6, node("SubqueryBroadcast", "SubqueryBroadcast other")),
            start(7), update(7, named),
        ],
        b=[start(1, "no app"), update(1, outer("LeftOuter", named, node("Scan")))],
    )
    assert sorted((r.log_id, r.execution_id) for r in d.outer_join_over(tables, "PartitionRecombination").collect()) == [("a", 1), ("a", 3), ("b", 1)]
    assert [r.execution_id for r in d.dynamic_pruning(tables).collect()] == [5]
    by_name = d.node_name_search(tables, "PartitionRecombination")
    assert sorted((r.log_id, r.execution_id) for r in by_name.collect()) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("a", 7), ("b", 1)]
    lost = by_name.filter("log_id = 'b'").first()
    assert (lost.url, lost.sql) == (None, "no app")
    assert d.node_name_search(tables, "It's \"quoted\"").count() == 0


def test_schedule_delay(log):
    tables = log(
        a=[
            app(attempt="2"),
            task(7, 1, launch=1000, done=241_001, run=0),
            task(7, 2, launch=1000, done=241_000),
            task(7, 3, launch=1000, got=241_100, done=900_000, deserialize=10, run=80, serialize=9),
            task(7, 4, launch=1000, got=500, done=300_000, run=100),
            task(7, 5, reason="ExceptionFailure", launch=0, done=900_000),
            task(7, 1, launch=1000, done=241_001, run=0),
        ]
    )
    found = {r.detail["task_id"]: (r.detail["delay_ms"], r.url) for r in d.schedule_delay(tables, base_url="http://b").collect()}
    url = "http://b/application_1_1/stages/stage/?id=7&attempt=0"
    assert found == {"1": ("240001", url), "3": ("240001", url), "4": ("298900", url)}
    assert {r.task_id for r in d.schedule_delays(tables).collect()} == {1, 3, 4}


def test_costly_small_side_join(log):
    join = node("SortMergeJoin", "SortMergeJoin [a#1], [b#2], Inner", [
        node("Filter", children=[node("Scan", rows=4)], rows=3),
        node("HashAggregate", children=[node("Exchange", children=[node("Scan", rows=6)])], rows=5),
    ], rows=2)
    plan = node("Project", children=[join])
    values = [(2, 50), (3, 200), (4, 900), (5, 50), (6, 70)]
    tables = log(
        a=[
            app(), start(1, "q", 1000), final(1, plan), driver(1, *values), end(1, 1031),
            start(2, "short", 1000), final(2, plan), end(2, 1030),
            start(3, "not final", 1000), update(3, node("AdaptiveSparkPlan", "AdaptiveSparkPlan isFinalPlan=false", [plan])), end(3, 2000),
        ]
    )
    limits = {"big_rows": 100, "small_rows": 100, "agg_input_rows": 1000}
    found = d.costly_small_side_join(tables, **limits).collect()
    assert len(found) == 1 and found[0].execution_id == 1
    assert {k: v for k, v in found[0].detail.items() if k.endswith("rows")} == {"rows": "50", "left_rows": "200", "right_rows": "50"}
    assert found[0].detail["join_cost"] == (
        "SortMergeJoin rows = 50 \n:- Scan rows = 200 \n+- HashAggregate rows = 50 priority = 7142.0\n   +- Scan rows = 70 \n"
    )
    assert found[0].detail["plan_cost"] == (
        "SortMergeJoin rows = 50 \n:- Filter rows = 200 priority = 2222.0\n:  +- Scan rows = 900 \n"
        "+- HashAggregate rows = 50 priority = 7142.0\n   +- Scan rows = 70 \n"
    )
    assert d.costly_small_side_join(tables, **{**limits, "agg_input_rows": 60}).count() == 0
    assert d.costly_small_side_join(tables, **{**limits, "big_rows": 200}).count() == 0


def test_only_final_plans_are_unfolded_for_costly_joins(log):
    join = node("SortMergeJoin", "SortMergeJoin [a#1], [b#2], Inner", [node("Scan", rows=3), node("Scan", rows=4)], rows=2)
    running = node("AdaptiveSparkPlan", "AdaptiveSparkPlan isFinalPlan=false", [join])
    tables = log(a=[app(), start(1, "q", 1000), update(1, running), final(1, join), driver(1, (2, 50), (3, 200), (4, 50)), end(1, 1031)])
    found = d.costly_small_side_joins(tables, big_rows=100, small_rows=100, agg_input_rows=1000)
    assert [(r.execution_id, r.rows, r.left_rows, r.right_rows) for r in found.collect()] == [(1, 50, 200, 50)]
    assert [saved.of("plan").count() for saved in tables._once.values()] == [1]


def test_costly_joins_with_a_count_of_nothing_and_unknown_counts(log):
    def plan(left, right, rows):
        return final(1, node("SortMergeJoin", "SortMergeJoin [a#1], [b#2], Inner", [node("Scan", rows=left), node("Scan", rows=right)], rows=rows))

    # Metrics 8 and 9 were never written and count -1, which is above -2 but never above 0.
    tables = log(a=[app(), start(1, "q", 1000), plan(8, 9, 9), plan(3, 4, 4), driver(1, (3, 200), (4, 50)), end(1, 1031)])

    def rows(big_rows):
        found = d.costly_small_side_joins(tables, big_rows=big_rows, small_rows=100, agg_input_rows=1000)
        return sorted((r.rows, r.left_rows, r.right_rows) for r in found.collect())

    assert rows(0) == [(50, 200, 50)]
    assert rows(-2) == [(-1, -1, -1), (50, 200, 50)]


def test_registry_runs_custom_detectors(log):
    @d.detector("mine")
    def mine(tables, word="Scan"):
        nodes = d.match_nodes(tables, F.col("simple_string").contains(word))
        return as_findings(d.with_context(nodes.select("log_id", "execution_id", "node_no"), tables), "mine", ["node_no"])

    try:
        tables = log(a=[app(), start(1), update(1, node("P", children=[node("Scan x"), node("Scan y")]))])
        found = d.run_detectors(tables, ["mine", "dynamic_pruning"], mine={"word": "Scan y"}).collect()
    finally:
        del d.DETECTORS["mine"]
    assert [(r.detector, r.detail) for r in found] == [("mine", {"node_no": "2"})]


def test_all_detectors_run_together(log):
    assert d.run_detectors(log(a=[app(), start(1), update(1, node("Scan")), task()])).count() == 0


LIMITS = {"big_rows": 100, "small_rows": 100, "agg_input_rows": 1000}


def test_costly_joins_store_only_what_they_ask(log):
    join = node("SortMergeJoin", "SortMergeJoin [a#1], [b#2], Inner", [node("Scan", rows=3), node("Scan", rows=4)], rows=2)
    first = [start(1, "q", 1000), job(1, "g"), final(1, join), driver(1, (2, 50), (3, 200), (4, 50)), end(1, 1031)]
    broken = '{"Event":"%s","executionId":2,"sparkPlanInfo":{"children":[{],"metadata":{}},"time":5}' % first[0]["Event"]
    tables = log(a=[app(), *first, broken])
    assert [(r.execution_id, r.sql) for r in d.costly_small_side_join(tables, **LIMITS).collect()] == [(1, "q")]
    (saved,) = tables._once.values()
    assert "job" not in saved._saved.columns
    # The initial plan holds no join: it is read, so that a broken line is known, but not unfolded.
    assert saved._saved.filter("kind = 'sql_start' AND nodes IS NULL").count() == saved.of("sql_start").count() == 1
    assert [r.reason for r in saved._saved.filter("kind = 'corrupt'").collect()] == ["broken json"]


def test_only_plans_with_a_big_and_a_small_count_are_gathered(log):
    def plan(execution, left, right, rows):
        inputs = [node("Scan", **({} if i is None else {"rows": i})) for i in (left, right)]
        return final(execution, node("SortMergeJoin", "SortMergeJoin [a#1], [b#2], Inner", inputs, **({} if rows is None else {"rows": rows})))

    values = [(3, 200), (4, 50), (5, 900)]
    # Written small, never written, no metric; then two big ones and two small ones.
    plans = [plan(1, 3, 4, 4), plan(2, 3, 9, 9), plan(3, None, 3, None), plan(4, 3, 5, 3), plan(5, 4, 4, 4)]
    tables = log(a=[app(), *[start(i, "q", 1000) for i in range(1, 6)], *plans, driver(1, *values), *[end(i, 2000) for i in range(1, 6)]])
    outlined = stash(d.final_outlines(tables), "outlines")
    likely = costs.with_big_and_small(outlined, metrics(tables), LIMITS["big_rows"], LIMITS["small_rows"])
    assert sorted(r.execution_id for r in likely.collect()) == [1, 2, 3]
    found = sorted((r.execution_id, r.rows, r.left_rows, r.right_rows) for r in d.costly_small_side_joins(tables, **LIMITS).collect())
    assert found == [(1, 50, 200, 50), (2, -1, 200, -1), (3, 0, 0, 200)]
    simplified = costs.simplified_cost(d.final_outlines(tables), metrics(tables))
    whole = costs.small_side_joins(simplified, **LIMITS).collect()
    assert sorted((r.execution_id, r.rows, r.left_rows, r.right_rows) for r in whole) == found


def test_executions_of_costly_joins_are_gathered_once(log, monkeypatch):
    asked = []
    monkeypatch.setattr(d, "sql_executions", lambda *a, **k: asked.append(a) or sql_executions(*a, **k))
    join = node("SortMergeJoin", "SortMergeJoin [a#1], [b#2], Inner", [node("Scan", rows=3), node("Scan", rows=4)], rows=2)
    tables = log(a=[app(), start(1, "q", 1000), final(1, join), driver(1, (2, 50), (3, 200), (4, 50)), end(1, 1031)])
    assert d.costly_small_side_join(tables, **LIMITS).count() == 1 and len(asked) == 1
