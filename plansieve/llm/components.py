"""Connected components by union-find in tasks and one shuffle a round."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansieve.operators.narrow import stash

HELD_NODES = 200_000  # a task hands on what it has joined when it holds so many nodes

_ROOTS_ARROW = pa.schema([("node", pa.int64()), ("root", pa.int64())])


def _join_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of the task's edges with the smallest node it is joined to there; roots name themselves."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def hand_on() -> pa.RecordBatch:
        rows = [(x, root(x)) for x in parent]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], schema=_ROOTS_ARROW)

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= HELD_NODES:
            yield hand_on()
    if parent:
        yield hand_on()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of an edge; ``edges`` has columns a and b.

    Each task joins its own edges first. A node then has at most one root per task: it takes the smallest, and the
    others become edges to that one, the next round's input, which is far smaller. However many edges a node has, the
    shuffle gets one row of it per task.
    """
    rounds = []
    while True:
        merged = (
            edges.select("a", "b")
            .mapInArrow(_join_in_task, "node long, root long")
            .groupBy("node")
            .agg(F.min("root").alias("root"), F.collect_set("root").alias("roots"))
        )
        rounds.append(stash(merged, "components"))
        others = F.explode(F.filter("roots", lambda r: r != F.col("root")))
        edges = rounds[-1].select(others.alias("a"), F.col("root").alias("b"))
        if edges.isEmpty():
            break
    found = rounds.pop().select("node", F.col("root").alias("component"))
    for earlier in reversed(rounds):
        later = found.select(F.col("node").alias("root"), "component")
        found = earlier.select("node", "root").join(later, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
    return found
