"""Logged physical plans as rows: flattening plan trees and questions about their shape.

A logged plan is one JSON value of unbounded depth inside one line. It is flattened inside that line's row
to an array of nodes in depth-first order. Each node knows the position of its parent and of the last node below it, so a
node's ancestors are found by climbing and its subtree is a range of the array. Such questions are look-ups in the row and need
neither recursion nor joins, so no node is shuffled before a question has narrowed the rows down.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansieve.events import (
    COALESCED_READER_TEXTS,
    FINAL_PLAN_TEXT,
    PARTITIONS_METRIC,
    SHUFFLE_READERS,
    SORT_MERGE_JOINS,
)
from plansieve.functions.text import hash_partition_count
from plansieve.operators.context import lookup_metric
from plansieve.plans import shape
from plansieve.sources.decode import EventTables

PLAN_KEY = ["log_id", "execution_id", "ord"]


def plan_updates(tables: EventTables, include_initial_plans: bool = False, words: tuple[str, ...] = ()) -> DataFrame:
    """(log_id, execution_id, ord, is_final, nodes, names, marks): one row per logged plan.

    ``nodes`` is the tree in depth-first order; ``names`` and ``marks`` tell which node names and which of the texts
    ``events.PLAN_MARKS`` are in it. Initial plans, logged with the start of an execution, are left out unless asked for.

    ``words`` are texts that every plan asked for contains: lines of text without them are spared the JSON parse. Words must be plain
    letters, digits, blanks or ``(``, which JSON writes as they are (:func:`json_plain`).
    """
    plans = tables.plans(*(("plan", "sql_start") if include_initial_plans else ("plan",)), words=words)
    return plans.select(
        "log_id",
        F.col("executionId").alias("execution_id"),
        "ord",
        F.coalesce(F.get("nodes", F.lit(0))["simple_string"] == FINAL_PLAN_TEXT, F.lit(False)).alias("is_final"),
        "nodes",
        "names",
        "marks",
    )


def json_plain(word: str) -> bool:
    """Whether JSON writes ``word`` as it is, so that it can be searched in raw lines."""
    return word.isascii() and word.isprintable() and not set(word) & set('"\\/<>&\'')


def has_name(*names: str) -> Column:
    """Whether a plan has a node of one of the names."""
    return F.arrays_overlap("names", F.array(*map(F.lit, names)))


def has_mark(*marks: str) -> Column:
    """Whether a plan has one of the marks. Written so that a saved table's pages without it are passed over."""
    found = F.col(f"marks.{marks[0]}") == F.lit(True)
    for mark in marks[1:]:
        found = found | (F.col(f"marks.{mark}") == F.lit(True))
    return found


def plan_trees(updates: DataFrame) -> DataFrame:
    """Each plan's key and ``nodes``."""
    return updates.select("log_id", "execution_id", "ord", "is_final", "nodes")


def plan_nodes(trees: DataFrame) -> DataFrame:
    """One row per plan node. Breadth-first order of a plan is ``orderBy(depth, node_no)``."""
    return trees.select("log_id", "execution_id", "ord", "is_final", F.inline("nodes"))


def node_at(nodes: Column, position: Column) -> Column:
    return F.get(nodes, position)


def metric_id(metrics: Column, name: str) -> Column:
    """Accumulator id of the first metric called ``name``; NULL when the node lists none."""
    return F.get(F.filter(metrics, lambda m: m["name"] == name), F.lit(0))["accumulator_id"]


def collect_nodes(trees: DataFrame, predicate) -> DataFrame:
    """(plan key, matches): per plan, the nodes for which ``predicate(node)`` holds, in breadth-first order."""
    matches = F.filter("nodes", predicate)
    ordered = F.array_sort(
        F.transform(matches, lambda n: F.struct(n["depth"].alias("depth"), n["node_no"].alias("node_no"), n.alias("node")))
    )
    return trees.select(*PLAN_KEY, F.transform(ordered, lambda o: o["node"]).alias("matches"))


def climb(nodes: Column, node: Column, start: Column, step: Callable[[Column, Column, Column], Column]) -> Column:
    """Fold over the ancestors of ``node`` from its parent up: ``step(found, ancestor, node below it)`` gives the next ``found``."""
    found = start.alias("found")
    begin = F.struct(node["parent_no"].alias("at"), node["node_no"].alias("via"), found)

    def up(state: Column, _: Column) -> Column:
        ancestor = node_at(nodes, state["at"])
        return F.struct(
            ancestor["parent_no"].alias("at"),
            state["at"].alias("via"),
            step(state["found"], ancestor, node_at(nodes, state["via"])).alias("found"),
        )

    levels = F.when(node["depth"] > 0, F.sequence(F.lit(1), node["depth"])).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, begin, up)["found"]


def path(nodes: Column, node: Column) -> Column:
    """Which child to take at each step from the root down to the node; empty for the root."""
    return climb(nodes, node, F.array().cast("array<int>"), lambda steps, _, below: F.concat(F.array(below["child_pos"]), steps))


def node_paths(nodes: Column) -> Column:
    """Every node's path as text (``0.1.0``), in the order of the nodes."""
    return shape.paths(F.transform(nodes, lambda n: n["parent_no"]), F.transform(nodes, lambda n: n["child_pos"]))


def is_below(node: Column, top: Column) -> Column:
    """Whether a node is in the subtree of another one of its plan, itself included."""
    return (node["node_no"] >= top["node_no"]) & (node["node_no"] <= top["last_below"])


def ancestor_lists(trees: DataFrame) -> DataFrame:
    """(plan key, node_no, ancestors): every node with the list of its ancestors, from the root down, and itself."""
    listed = shape.lineages(F.transform("nodes", lambda n: n["parent_no"]))
    return trees.select(*PLAN_KEY, F.posexplode(listed).alias("node_no", "ancestors"))


def ancestors(trees: DataFrame) -> DataFrame:
    """(plan key, node_no, ancestor_no, distance): every node with itself and each of its ancestors."""
    return ancestor_lists(trees).select(*PLAN_KEY, "node_no", F.inline("ancestors"))


def subtree_hash_partitions(nodes: Column, node_no: Column) -> Column:
    """Partition count of the first hash exchange on the node's first-child chain; NULL when there is none."""
    return hash_partition_count(node_at(nodes, node_at(nodes, node_no)["next_hash_exchange"])["simple_string"])


def _ends_search(name: Column) -> Column:
    """Nodes at which the search for a shuffle below a join input stops, with a hit or without."""
    return (
        name.isin("Exchange", "BroadcastExchange", *SHUFFLE_READERS)
        | name.contains("Scan parquet")
        | name.contains("AdaptiveSparkPlan")
    )


def shuffles_below_inputs(trees: DataFrame, parents: tuple[str, ...] = SORT_MERGE_JOINS) -> DataFrame:
    """Exchanges and shuffle readers that a search down from an input of a ``parents`` node would reach.

    One row per (plan, parent_no, side, node): the search reaches a node when nothing that ends a search
    lies between it and the input.
    """
    nodes = F.col("nodes")
    shuffles = F.filter(nodes, lambda n: n["node_name"].isin("Exchange", *SHUFFLE_READERS))
    nothing = F.struct(F.lit(True).alias("is_open"), F.array().cast("array<struct<parent_no:int,side:int>>").alias("inputs"))

    def step(found: Column, ancestor: Column, below: Column) -> Column:
        # The nearest ancestor that ends a search hides the node from every join above it.
        is_open = found["is_open"] & ~_ends_search(ancestor["node_name"])
        here = F.array(F.struct(ancestor["node_no"].alias("parent_no"), below["child_pos"].alias("side")))
        inputs = F.when(is_open & ancestor["node_name"].isin(*parents), F.concat(found["inputs"], here)).otherwise(found["inputs"])
        return F.struct(is_open.alias("is_open"), inputs.alias("inputs"))

    def reached(n: Column) -> Column:
        return F.transform(
            climb(nodes, n, nothing, step)["inputs"],
            lambda at: F.struct(
                at["parent_no"].alias("parent_no"),
                at["side"].alias("side"),
                n["node_no"].alias("node_no"),
                n["node_name"].alias("node_name"),
                n["simple_string"].alias("simple_string"),
                metric_id(n["metrics"], PARTITIONS_METRIC).alias("partitions_id"),
                F.when(n["node_name"].isin(*SHUFFLE_READERS), subtree_hash_partitions(nodes, n["node_no"])).alias("hash_partitions"),
            ),
        )

    return trees.select(*PLAN_KEY, F.inline(F.flatten(F.transform(shuffles, reached))))


def _hits(reached: DataFrame, metrics: DataFrame) -> DataFrame:
    """Reached nodes that count as a shuffle: plain exchanges, and readers that changed their exchange's count."""
    return lookup_metric(reached, "partitions_id", metrics, "partitions").filter(
        (F.col("node_name") == "Exchange") | (F.col("hash_partitions") != F.col("partitions"))
    ).withColumn(
        "unclear", F.coalesce((F.col("partitions") == -1) | (F.col("hash_partitions") == 0), F.lit(False))
    )


def first_shuffles(reached: DataFrame, metrics: DataFrame) -> DataFrame:
    """(plan key, parent_no, side, node_no, node_name, simple_string, hash_partitions, partitions, unclear).

    Of the ``reached`` nodes (:func:`shuffles_below_inputs`), the first shuffle below each join input in
    depth-first order: a plain exchange, or a shuffle reader whose partition count is known and differs from its exchange's. ``unclear`` marks
    readers whose count was never written or whose exchange text could not be read.
    """
    fields = ["node_name", "simple_string", "hash_partitions", "partitions", "unclear"]
    return (
        _hits(reached, metrics)
        .groupBy(*PLAN_KEY, "parent_no", "side")
        .agg(F.min("node_no").alias("node_no"), *[F.min_by(f, "node_no").alias(f) for f in fields])
    )


def uneven_joins(reached: DataFrame, metrics: DataFrame) -> DataFrame:
    """(plan key, parent_no, exchange_side, hash_partitions, partitions, unclear) of unevenly shuffled joins.

    One input's first shuffle is a plain exchange, the other's a reader that coalesced its partitions.
    """
    first = F.struct("node_name", "simple_string", "hash_partitions", "partitions", "unclear")
    # Both inputs of a join meet in one aggregate, keyed by the join: no self-join of the two sides.
    sides = (
        _hits(reached, metrics)
        .groupBy(*PLAN_KEY, "parent_no")
        .agg(
            F.min_by(first, F.when(F.col("side") == 0, F.col("node_no"))).alias("left"),
            F.min_by(first, F.when(F.col("side") == 1, F.col("node_no"))).alias("right"),
        )
    )

    def is_match(exchange: str, reader: str) -> Column:
        return (F.col(f"{exchange}.node_name") == "Exchange") & F.col(f"{reader}.simple_string").isin(
            *COALESCED_READER_TEXTS
        )

    exchange_side = F.when(is_match("left", "right"), 0).when(is_match("right", "left"), 1)
    reader = F.when(F.col("exchange_side") == 0, F.col("right")).otherwise(F.col("left"))
    return (
        sides.withColumn("exchange_side", exchange_side)
        .filter(F.col("exchange_side").isNotNull())
        .select(
            *PLAN_KEY,
            "parent_no",
            "exchange_side",
            reader["hash_partitions"].alias("hash_partitions"),
            reader["partitions"].alias("partitions"),
            reader["unclear"].alias("unclear"),
        )
    )
