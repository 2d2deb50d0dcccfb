"""Tree operators against plain recursion on random trees."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import LINES_SCHEMA, driver, final, node, start, update
from plansieve import events as ev
from plansieve import samples
from plansieve.operators import context, narrow
from plansieve.operators.narrow import stash
from plansieve.plans import cost, tree
from plansieve.sources.decode import EventTables

NAMES = [
    "SortMergeJoin", "SortMergeJoin", "Exchange", "AQEShuffleRead", "CustomShuffleReader", "BroadcastExchange", "Scan parquet ",
    "HashAggregate", "HashAggregate", "Project", "Sort", "Union", "BroadcastHashJoin",
]


def random_tree(rng, ids, depth=0):
    name = rng.choice(NAMES)
    n = rng.choice([0, 1, 1, 1, 2, 2, 3]) if depth < 7 else 0
    if name == "Exchange":
        text = rng.choice(["Exchange hashpartitioning(a#1, 5), x", "Exchange hashpartitioning(a#1, 7)", "Exchange SinglePartition"])
    elif name in ("AQEShuffleRead", "CustomShuffleReader"):
        text = rng.choice([f"{name} coalesced", f"{name} local"])
    elif name.endswith("Join"):
        text = f"{name} [a#1], [b#2], {rng.choice(['Inner', 'LeftOuter'])}"
    else:
        text = name
    metrics = {}
    if rng.random() < 0.5:
        metrics["rows"] = next(ids)
    if rng.random() < 0.6:
        metrics["partitions"] = next(ids)
    return node(name, text, [random_tree(rng, ids, depth + 1) for _ in range(n)], **metrics)


class Model:
    """Straight recursive answers for one plan."""

    def __init__(self, plan, values):
        self.values = values
        self.nodes = []
        self.root = self.number(plan, (), None)

    def number(self, raw, path, parent):
        metrics = {m["name"]: m["accumulatorId"] for m in raw["metrics"]}
        n = {
            "no": len(self.nodes), "path": path, "parent": parent, "name": raw["nodeName"], "text": raw["simpleString"],
            "rows": self.metric(metrics.get("number of output rows")), "parts": self.metric(metrics.get("number of partitions")),
        }
        self.nodes.append(n)
        n["kids"] = [self.number(c, path + (i,), n) for i, c in enumerate(raw["children"])]
        return n

    def metric(self, number):
        return None if number is None else self.values.get(number, -1)

    def hash_parts(self, n):
        while True:
            if n["text"].startswith("Exchange hashpartitioning"):
                digits = n["text"].split(",")[1].split(")")[0]
                return int(digits)
            if not n["kids"]:
                return None
            n = n["kids"][0]

    def shuffle(self, n):
        name = n["name"]
        if name == "Exchange":
            return n
        if name in ("AQEShuffleRead", "CustomShuffleReader"):
            known = self.hash_parts(n), n["parts"]
            return n if None not in known and known[0] != known[1] else None
        if name == "BroadcastExchange" or "Scan parquet" in name or "AdaptiveSparkPlan" in name:
            return None
        for kid in n["kids"]:
            hit = self.shuffle(kid)
            if hit:
                return hit
        return None

    def cost(self, n):
        kids = [self.cost(k) for k in n["kids"]]
        if n["rows"] is None and len(kids) == 1:
            return kids[0]
        return {"no": n["no"], "name": n["name"], "text": n["text"], "rows": n["rows"] or 0, "kids": kids}

    def simple(self, c):
        kids = [self.simple(k) for k in c["kids"]]
        if len(kids) == 1 and c["name"] != "HashAggregate":
            return {**kids[0], "rows": c["rows"]}
        return {**c, "kids": kids}

    def small(self, c, small, big):
        if len(c["kids"]) > 1:
            return False
        if not c["kids"]:
            return c["rows"] < small
        kid = c["kids"][0]
        return not (c["rows"] < small and kid["rows"] > big) and self.small(kid, small, big)

    def priority(self, c):
        rows = [k["rows"] for k in c["kids"]]
        if not rows or c["rows"] in rows:
            return 10000
        if not max(rows):
            return None
        whole = abs(10000 * c["rows"]) // abs(max(rows))
        return whole if c["rows"] * max(rows) >= 0 else -whole

    def draw(self, c, lead="", mark=""):
        p = self.priority(c)
        tail = f"priority = {as_double(p)}" if p not in (10000, None) else ""
        out = f"{mark}{c['name']} rows = {c['rows']} {tail}\n"
        for i, kid in enumerate(c["kids"]):
            last = i == len(c["kids"]) - 1
            out += self.draw(kid, lead + ("   " if last else ":  "), lead + ("+- " if last else ":- "))
        return out


def as_double(n):
    """A whole number as the JVM prints a double."""
    digits, sign = str(abs(n)), "-" if n < 0 else ""
    if len(digits) < 8:
        return f"{sign}{digits}.0"
    return f"{sign}{digits[0]}.{digits[1:].rstrip('0') or '0'}E{len(digits) - 1}"


def walk(c, parent=None):
    yield c, parent
    for kid in c["kids"]:
        yield from walk(kid, c)


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(11)
    ids = iter(range(1, 10**9))
    plans = {i: random_tree(rng, ids) for i in range(300)}
    for i in range(301, 381):
        plain = node("Sort", children=[node("Exchange", "Exchange hashpartitioning(a#1, 5)", [random_tree(rng, ids, 6)])])
        reader = rng.choice(["AQEShuffleRead", "CustomShuffleReader"])
        listed = {"partitions": next(ids)} if rng.random() < 0.8 else {}
        below = node("Exchange", "Exchange hashpartitioning(b#2, 7)", [random_tree(rng, ids, 6)])
        coalesced = node("Project", children=[node(reader, f"{reader} coalesced", [below], **listed)])
        sides = [plain, coalesced]
        rng.shuffle(sides)
        plans[i] = node("Union", children=[random_tree(rng, ids, 5), node("SortMergeJoin", "SortMergeJoin [a#1], [b#2], Inner", sides)])
    deep = node("Scan parquet ", rows=next(ids))
    for i in range(400):
        deep = node("Project" if i % 7 else "HashAggregate", children=[deep], **({"rows": next(ids)} if i % 3 == 0 else {}))
    plans[300] = node("SortMergeJoin", "SortMergeJoin [a#1], [b#2], Inner", [deep, node("Exchange", "Exchange hashpartitioning(a#1, 5)")], rows=next(ids))
    values = {i: rng.choice([0, 5, 7, 100, 5000, 90000]) for i in range(1, next(ids)) if rng.random() < 0.9}
    import json
    from decimal import Decimal

    from conftest import LINES_SCHEMA
    from plansieve.sources.decode import EventTables

    text = lambda e: json.dumps(e, separators=(",", ":"))
    rows = [("a", Decimal(i), text(update(i, p))) for i, p in plans.items()]
    rows += [("a", Decimal(1000), text(driver(0, *values.items())))]
    tables = EventTables.from_lines(spark.createDataFrame(rows, LINES_SCHEMA).repartition(4))
    trees = tree.plan_trees(tree.plan_updates(tables)).persist()
    metrics = context.metrics(tables).persist()
    return trees, metrics, {i: Model(p, values) for i, p in plans.items()}


def test_flatten(forest):
    trees, _, models = forest
    nodes = F.col("nodes")
    with_path = trees.withColumn("nodes", F.transform(nodes, lambda n: n.withField("path", tree.path(nodes, n))))
    found = {
        (r.execution_id, r.node_no): (tuple(r.path), r.depth, r.child_pos, r.node_name, r.simple_string, r.n_children, r.parent_no, r.last_below)
        for r in tree.plan_nodes(with_path).collect()
    }

    def last(n):
        return last(n["kids"][-1]) if n["kids"] else n["no"]

    want = {
        (i, n["no"]): (
            n["path"], len(n["path"]), n["path"][-1] if n["path"] else None, n["name"], n["text"], len(n["kids"]), n["parent"]["no"] if n["parent"] else None, last(n),
        )
        for i, m in models.items() for n in m.nodes
    }
    assert found == want


def test_collect_nodes_is_breadth_first(forest):
    trees, _, models = forest
    matches = tree.collect_nodes(trees, lambda n: n["node_name"] == "HashAggregate").collect()
    found = {r.execution_id: [n.node_no for n in r.matches] for r in matches}
    for i, m in models.items():
        order = sorted(m.nodes, key=lambda n: (len(n["path"]), n["path"]))
        assert found[i] == [n["no"] for n in order if n["name"] == "HashAggregate"]


def test_ancestors(forest):
    trees, _, models = forest
    found = {(r.execution_id, r.node_no, r.ancestor_no, r.distance) for r in tree.ancestors(trees).collect()}
    want = set()
    for i, m in models.items():
        for n in m.nodes:
            up, distance = n, 0
            while up:
                want.add((i, n["no"], up["no"], distance))
                up, distance = up["parent"], distance + 1
    assert found == want


def test_subtree_hash_partitions(forest):
    trees, _, models = forest
    per_node = F.transform("nodes", lambda n: tree.subtree_hash_partitions(F.col("nodes"), n["node_no"]))
    for r in trees.select("execution_id", per_node.alias("found")).collect():
        assert r.found == [models[r.execution_id].hash_parts(n) for n in models[r.execution_id].nodes]


def test_first_shuffles(forest):
    trees, metrics, models = forest
    found = {(r.execution_id, r.parent_no, r.side): r.node_no for r in tree.first_shuffles(tree.shuffles_below_inputs(trees), metrics).collect()}
    want = {}
    for i, m in models.items():
        for n in m.nodes:
            if n["name"] == "SortMergeJoin":
                for side, kid in enumerate(n["kids"]):
                    hit = m.shuffle(kid)
                    if hit:
                        want[i, n["no"], side] = hit["no"]
    assert found == want and len(want) > 50


def test_uneven_joins(forest):
    trees, metrics, models = forest
    found = {(r.execution_id, r.parent_no): r.exchange_side for r in tree.uneven_joins(tree.shuffles_below_inputs(trees), metrics).collect()}
    coalesced = ("AQEShuffleRead coalesced", "CustomShuffleReader coalesced")
    want = {}
    for i, m in models.items():
        for n in m.nodes:
            if n["name"] == "SortMergeJoin" and len(n["kids"]) >= 2:
                a, b = m.shuffle(n["kids"][0]), m.shuffle(n["kids"][1])
                if a and b and a["name"] == "Exchange" and b["text"] in coalesced:
                    want[i, n["no"]] = 0
                elif a and b and b["name"] == "Exchange" and a["text"] in coalesced:
                    want[i, n["no"]] = 1
    assert found == want and len(want) > 3


@pytest.mark.parametrize("simplify", [False, True])
def test_cost_trees(forest, simplify):
    trees, metrics, models = forest
    reduced = (cost.simplified_cost if simplify else cost.plan_cost)(trees, metrics)
    found = {(r.execution_id, r.node_no): (r.parent_no, r.node_name, r.rows) for r in cost.cost_nodes(reduced).collect()}
    priorities = {(r.execution_id, r.node_no): r.priority for r in cost.priorities(reduced).collect()}
    texts = {r.execution_id: r.text for r in cost.cost_text(reduced).collect()}
    for i, m in models.items():
        top = m.cost(m.root)
        top = m.simple(top) if simplify else top
        seen = {(i, c["no"]): (p and p["no"], c["name"], c["rows"]) for c, p in walk(top)}
        assert {k: v for k, v in found.items() if k[0] == i} == seen
        assert {k[1]: v for k, v in priorities.items() if k[0] == i} == {c["no"]: m.priority(c) for c, _ in walk(top)}
        assert texts[i] == m.draw(top)


def test_small_inputs_and_joins(forest):
    trees, metrics, models = forest
    simplified = cost.simplified_cost(trees, metrics)
    found = {(r.execution_id, r.branch_no, r.branch_side): (r.rows, r.is_small) for r in cost.small_inputs(simplified, 50, 1000).collect()}
    joins_df = cost.small_side_joins(simplified, 1000, 50, 1000).persist()
    joins = {(r.execution_id, r.node_no): (r.rows, r.left_rows, r.right_rows) for r in joins_df.collect()}
    drawn = {(r.execution_id, r.node_no): r.text for r in cost.cost_text(simplified, joins_df).collect()}
    want, want_joins = {}, {}
    for i, m in models.items():
        for c, _ in walk(m.simple(m.cost(m.root))):
            if len(c["kids"]) < 2:
                continue
            for side, kid in enumerate(c["kids"]):
                want[i, c["no"], side] = (kid["rows"], m.small(kid, 50, 1000))
            if c["name"].endswith("Join") and "Inner" in c["text"] and len(c["kids"]) == 2:
                a, b = c["kids"]
                fits = (a["rows"] > 1000 and m.small(b, 50, 1000)) or (b["rows"] > 1000 and m.small(a, 50, 1000))
                if fits and c["rows"] == min(a["rows"], b["rows"]):
                    want_joins[i, c["no"]] = (c["rows"], a["rows"], b["rows"])
                    assert drawn[i, c["no"]] == m.draw(c)
    assert found == want
    assert joins == want_joins and len(joins) == len(drawn)


def test_plan_updates_mark_final_plans_and_may_include_initial_ones(spark, log):
    tables = log(a=[start(1, plan=node("Scan")), update(1, node("AdaptiveSparkPlan", "AdaptiveSparkPlan isFinalPlan=false")), final(1, node("Scan"))])
    assert [r.is_final for r in tree.plan_updates(tables).orderBy("ord").collect()] == [False, True]
    assert tree.plan_nodes(tree.plan_trees(tree.plan_updates(tables, include_initial_plans=True))).count() == 4


def test_plan_without_tree_is_skipped(spark, log):
    bare = update(1, None)
    del bare["sparkPlanInfo"]
    tables = log(a=[bare, update(2, node("Scan"))])
    assert [r.execution_id for r in tree.plan_nodes(tree.plan_trees(tree.plan_updates(tables))).collect()] == [2]


@pytest.mark.parametrize("depth", [600, 20_000])
def test_deep_plans_are_whole_from_text_and_saved(spark, tmp_path, depth):
    def chain(n):
        # Written as text: the JSON writer is recursive, too.
        head = "".join(f'{{"nodeName":"N{k}","simpleString":"N{k} \\"children\\":[]","children":[' for k in range(n))
        return head + '],"metadata":{},"metrics":[{"name":"m","accumulatorId":7}]}' * n

    line = f'{{"Event":"{ev.PLAN_UPDATE}","executionId":5,"physicalPlanDescription":"x","sparkPlanInfo":{chain(depth)}}}'
    lines = spark.createDataFrame([("a", Decimal(1), line)], LINES_SCHEMA)
    text = EventTables.from_lines(lines)
    saved = text.save(str(tmp_path / "deep"))
    for tables in (text, saved):
        nodes = tree.plan_nodes(tree.plan_trees(tree.plan_updates(tables)))
        found = nodes.agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.max("execution_id").alias("x")).first()
        assert (found.n, found.deepest, found.x) == (depth, depth - 1, 5)
        assert tables.corrupt().count() == 0


def test_json_beyond_the_parser_recursion():
    from plansieve.plans.flatten import _loads

    text = '{"a":' * 60_000 + '[1,"x\\"}",{},[],null,-2.5e3]' + "}" * 60_000
    value = _loads(text)
    for _ in range(60_000):
        value = value["a"]
    assert value == [1, 'x"}', {}, [], None, -2500.0]
    with pytest.raises(ValueError):
        _loads(text[:-1])


def malformed(execution, change):
    plan = node("Project", children=[node("Scan", rows=7)])
    change(plan)
    return update(execution, plan)


MALFORMED = {
    "null child": lambda p: p.update(children=[None]),
    "children as text": lambda p: p.update(children="x"),
    "metric id as text": lambda p: p["children"][0]["metrics"][0].update(accumulatorId="7"),
    "name as number": lambda p: p["children"][0].update(nodeName=1),
    "metric id too large": lambda p: p["children"][0]["metrics"][0].update(accumulatorId=1 << 70),
    "metric that is no object": lambda p: p.update(metrics=[3]),
    "metrics as object": lambda p: p.update(metrics={"a": 1}),
}


@pytest.mark.parametrize("form", ["text", "saved"])
def test_malformed_plans_are_listed_and_do_not_stop_good_ones(log, tmp_path, form):
    good = node("Join", children=[node("Scan", rows=1), node("Scan", "text", rows=2)])
    bad = [malformed(100 + k, change) for k, change in enumerate(MALFORMED.values())]
    not_a_plan = {**update(200, None), "sparkPlanInfo": "plan"}
    begun = start(300, "select 1", plan=malformed(0, MALFORMED["null child"])["sparkPlanInfo"])
    tables = log(a=[update(1, good), *bad, not_a_plan, update(2, good), begun, {**update(3, good), "executionId": "3"}])
    if form == "saved":
        tables = tables.save(str(tmp_path / "events"))
    nodes = tree.plan_nodes(tree.plan_updates(tables, include_initial_plans=True)).orderBy("ord", "node_no").collect()
    assert [(n.execution_id, n.node_no, n.node_name, n.simple_string) for n in nodes] == [
        (k, *rest) for k in (1, 2) for rest in ((0, "Join", "Join"), (1, "Scan", "Scan"), (2, "Scan", "text"))
    ]
    listed = {int(r.ord): r.reason for r in tables.corrupt().collect()}
    n = len(MALFORMED)
    assert listed == {**{k: "broken plan" for k in range(1, n + 2)}, n + 3: "broken plan", n + 4: "broken json"}
    # An execution whose initial plan is malformed has started all the same.
    assert [(r.execution_id, r.sql) for r in context.sql_executions(tables).collect()] == [(300, "select 1")]


def test_signature_of_a_plan(log):
    plan = node("AdaptiveSparkPlan", children=[node("SortMergeJoin", "SortMergeJoin [a#1], [b#2], LeftOuter", [node("Sort"), node("Sort")]), node("X", "locate(a")])
    signature = tree.plan_updates(log(a=[update(1, plan)])).select("names", "marks.*").first().asDict()
    assert signature.pop("names") == ["AdaptiveSparkPlan", "Sort", "SortMergeJoin", "X"]
    assert {m for m, has in signature.items() if has} == {"locate", "sort_merge", "left_outer"}


def rows_scanned(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.length()))


def test_saved_plans_without_the_mark_are_not_read(log, tmp_path):
    from plansieve.operators.detectors import match_nodes

    rare = node("Project", children=[node("SubqueryBroadcast", "SubqueryBroadcast dynamicpruning#7")])
    tables = log(a=[update(k, rare if k % 40 == 0 else node("Project", children=[node("Scan")])) for k in range(16_000)]).save(str(tmp_path / "events"))
    found = match_nodes(tables, F.col("node_name") == "SubqueryBroadcast", where=tree.has_mark("dynamic_pruning")).select("execution_id")
    assert found.count() == 400
    assert rows_scanned(found) < 16_000 / 2


def test_texts_of_nodes_are_not_shuffled_for_cost_trees(forest, spark):
    trees, metrics, _ = forest
    for make in (cost.plan_cost, cost.simplified_cost):
        costs = make(trees, metrics)
        for df in (costs, cost.cost_text(costs), cost.small_side_joins(costs), cost.small_inputs(costs), cost.priorities(costs)):
            assert "simple_string" not in df._jdf.queryExecution().executedPlan().toString()


def test_large_plans_are_drawn_in_seconds(log):
    import time

    scans = [node("Scan", rows=k) for k in range(1, 20_001)]
    wide = node("Union", children=scans)
    for _ in range(14):
        scans = [node("Join", children=scans[i : i + 2]) if len(scans) > 1 else scans[0] for i in range(0, len(scans), 2)]
    tables = log(a=[update(1, wide), update(2, node("Root", children=scans)), driver(0, *[(k, k) for k in range(1, 20_001)])])
    begun = time.time()
    texts = {r.execution_id: r.text.split("\n") for r in cost.cost_text(cost.plan_cost(tree.plan_updates(tables), context.metrics(tables))).collect()}
    assert time.time() - begun < 60
    assert len(texts[1]) == 20_002 and texts[1][0] == "Union rows = 0 priority = 0.0" and texts[1][-2] == "+- Scan rows = 20000 "
    assert sum("Scan rows" in line for line in texts[2]) == 20_000


def test_metrics_are_never_gathered_in_the_driver(log, monkeypatch):
    plan = node("SortMergeJoin", "SortMergeJoin [a#1], [b#2], Inner", [node("Exchange"), node("Exchange")], rows=1)
    tables = log(a=[start(1), update(1, plan), driver(1, [1, 5])])
    trees = tree.plan_trees(tree.plan_updates(tables))
    for found in (
        cost.cost_nodes(cost.plan_cost(trees, context.metrics(tables))),
        tree.first_shuffles(tree.shuffles_below_inputs(trees), context.metrics(tables)),
    ):
        assert found.count()
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    # A few keys are sent to the rows, many meet them in a shuffle.
    stored = stash(context.metrics(tables), "metrics")
    few = context.metrics(tables, stored.select("log_id", "accumulator_id"))
    monkeypatch.setattr(narrow, "FEW_KEYS", 0)
    many = context.metrics(tables, stored.select("log_id", "accumulator_id"))
    assert few.collect() == many.collect() == stored.collect()
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()


def test_text_comes_in_blocks(spark, tmp_path, monkeypatch):
    orders = spark.range(1000).selectExpr("id AS o_orderkey", "id AS o_custkey", "1.5D AS o_totalprice", "timestamp_ntz'2020-01-01 00:00:00' AS o_orderdate")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(samples, "BLOCK_BYTES", 40_000)
    # 4,000 bytes an order: 10 orders a block.
    tasks = samples.plan_lines(spark, str(tmp_path)).filter("ord >= 0").groupBy(F.spark_partition_id()).agg(F.count_distinct("ord").alias("n"))
    assert tasks.agg(F.max("n"), F.sum("n")).first()["max(n)"] <= 80


def test_plans_without_a_large_count_are_left_out(forest):
    trees, metrics, *_ = forest
    whole = {tuple(r[k] for k in tree.PLAN_KEY): r.tree for r in cost.simplified_cost(trees, metrics).collect()}
    bound = 500
    some = {tuple(r[k] for k in tree.PLAN_KEY): r.tree for r in cost.simplified_cost(trees, metrics, some_above=bound).collect()}
    assert some == {k: t for k, t in whole.items() if max(n.rows for n in t) > bound}
    assert 0 < len(some) < len(whole)


def test_paths_and_lineages_without_climbing(forest):
    trees, _, _ = forest
    plan = trees.select(tree.node_paths(F.col("nodes")))._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" not in plan
    nodes = F.col("nodes")
    climbed = F.transform(nodes, lambda n: F.array_join(tree.path(nodes, n).cast("array<string>"), "."))
    assert trees.filter(~tree.node_paths(nodes).eqNullSafe(climbed)).count() == 0
