"""The one place where Python runs inside tasks: unfolding a plan's JSON into an array of nodes."""

from __future__ import annotations

import gc
import json
import re
import sys
from itertools import repeat

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plansieve.events import HASH_EXCHANGE, PLAN_MARKS

METRIC_TYPE = T.StructType().add("name", T.StringType()).add("accumulator_id", T.LongType())
NODE_TYPE = (
    T.StructType()
    .add("node_no", T.IntegerType())
    .add("parent_no", T.IntegerType())
    # Which child of its parent the node is, from 0.
    .add("child_pos", T.IntegerType())
    .add("depth", T.IntegerType())
    # The nodes below a node are those after it up to this one.
    .add("last_below", T.IntegerType())
    # The first hash exchange among the node, its first child, that one's first child and so on.
    .add("next_hash_exchange", T.IntegerType())
    .add("node_name", T.StringType())
    .add("simple_string", T.StringType())
    .add("n_children", T.IntegerType())
    .add("metrics", T.ArrayType(METRIC_TYPE))
)
# What a plan's node texts contain, known without reading its nodes.
MARKS_TYPE = T.StructType([T.StructField(mark, T.BooleanType()) for mark in PLAN_MARKS])
FLAT_TYPE = (
    T.StructType()
    .add("problem", T.StringType())
    .add("execution_id", T.LongType())
    .add("nodes", T.ArrayType(NODE_TYPE))
    .add("names", T.ArrayType(T.StringType()))
    .add("marks", MARKS_TYPE)
)
BROKEN_JSON, BROKEN_PLAN = "broken json", "broken plan"


def _lists(offsets: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\],:])|(")|([^\s{}\[\],:"]+))')


def _loads(text: str):
    """JSON of any depth: the standard parser first, and a stack where its recursion ends."""
    try:
        return json.loads(text)
    except RecursionError:
        pass
    top: list = []
    # Open containers with the key that waits for its value (in objects).
    opened, keys, at = [top], [None], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            break
        at = m.end()
        if m[1] in ("}", "]"):
            opened.pop()
            keys.pop()
            continue
        if m[1] in (",", ":"):
            continue
        if m[1]:
            value = {} if m[1] == "{" else []
        elif m[2]:
            value, at = json.decoder.scanstring(text, at)
        else:
            value = json.loads(m[3])
        into = opened[-1]
        if isinstance(into, list):
            into.append(value)
        elif keys[-1] is None:
            keys[-1] = value
            continue
        else:
            into[keys[-1]] = value
            keys[-1] = None
        if m[1]:
            opened.append(value)
            keys.append(None)
    if len(opened) != 1 or len(top) != 1:
        raise ValueError("unbalanced JSON")
    return top[0]


def _whole(value, what: str) -> int | None:
    """A 64-bit whole number or nothing; anything else is an error."""
    if value is not None and (type(value) is not int or not -(1 << 63) <= value < 1 << 63):
        raise ValueError(f"{what} is not a whole number")
    return value


class _Plans:
    """The columns of the nodes of many plans, filled plan by plan."""

    def __init__(self):
        self.columns: dict[str, list] = {f.name: [] for f in NODE_TYPE if f.name != "metrics"}
        self.metric_at, self.metric_names, self.metric_ids = [0], [], []
        self.plan_at = [0]

    def add(self, root: dict | None) -> None:
        """Number the nodes of one plan in depth-first order. A malformed plan raises and leaves the columns as they were."""
        n_metrics = len(self.metric_ids)
        try:
            self._add(root)
        except ValueError:
            del self.metric_names[n_metrics:], self.metric_ids[n_metrics:], self.metric_at[self.plan_at[-1] + 1 :]
            raise

    def _add(self, root: dict | None) -> None:
        # One step per node, and most of the time of reading plans: what a node may hold is tested in place.
        names, texts, parents, positions, depths, counts = [], [], [], [], [], []
        metric_at, metric_names, metric_ids = self.metric_at, self.metric_names, self.metric_ids
        waiting = [(root, None, None, 0)] if root is not None else []
        here = 0
        while waiting:
            node, parent, position, depth = waiting.pop()
            if type(node) is not dict:
                raise ValueError("a node is not an object")
            of = node.get
            name, text, children, metrics = of("nodeName"), of("simpleString"), of("children"), of("metrics")
            if name is not None and type(name) is not str or text is not None and type(text) is not str:
                raise ValueError("nodeName or simpleString is not text")
            names.append(name)
            texts.append(text)
            parents.append(parent)
            positions.append(position)
            depths.append(depth)
            if metrics is not None:
                if type(metrics) is not list:
                    raise ValueError("metrics is not a list")
                for metric in metrics:
                    if type(metric) is not dict:
                        raise ValueError("a metric is not an object")
                    name = metric.get("name")
                    if name is not None and type(name) is not str:
                        raise ValueError("a metric's name is not text")
                    metric_names.append(name)
                    metric_ids.append(_whole(metric.get("accumulatorId"), "accumulatorId"))
            metric_at.append(len(metric_ids))
            if children is not None and type(children) is not list:
                raise ValueError("children is not a list")
            if not children:
                counts.append(0)
            else:
                n = len(children)
                counts.append(n)
                depth += 1
                while n:
                    n -= 1
                    waiting.append((children[n], here, n, depth))
            here += 1
        last, exchange, below = list(range(here)), [None] * here, None
        # Children follow their parent, the first child directly, so one pass from the end fills both.
        for i in range(here - 1, -1, -1):
            parent, text = parents[i], texts[i]
            if parent is not None and last[parent] < last[i]:
                last[parent] = last[i]
            if text is not None and text.startswith(HASH_EXCHANGE):
                below = i
            elif not counts[i]:
                below = None
            exchange[i] = below
        found = {
            "node_no": range(here), "parent_no": parents, "child_pos": positions, "depth": depths, "last_below": last,
            "next_hash_exchange": exchange, "node_name": names, "simple_string": texts, "n_children": counts,
        }
        for name, values in found.items():
            self.columns[name].extend(values)
        self.plan_at.append(self.plan_at[-1] + here)

    def nodes(self) -> pa.Array:
        metric = pa.StructArray.from_arrays(
            [pa.array(self.metric_names, pa.string()), pa.array(self.metric_ids, pa.int64())], ["name", "accumulator_id"]
        )
        arrays = []
        for f in NODE_TYPE:
            if f.name == "metrics":
                arrays.append(_lists(self.metric_at, metric))
            else:
                arrays.append(pa.array(self.columns[f.name], pa.string() if f.dataType == T.StringType() else pa.int32()))
        return _lists(self.plan_at, pa.StructArray.from_arrays(arrays, NODE_TYPE.names))


@F.arrow_udf(FLAT_TYPE)
def flatten_plan(lines: pa.Array, wanted: pa.Array = None) -> pa.Array:
    """Each line's ``sparkPlanInfo`` as nodes in depth-first order, with what tells beforehand what is in the plan.

    A recursive type has no Spark schema, and the built-in ways round that (a recursive CTE, a fold over
    VARIANT, a nested schema) cost a shuffle or a copy of the remaining tree per level. One pass per line
    over Arrow batches has no depth limit; its cost and the memory of its result are the plan's size.

    ``problem`` says why a line has no nodes although it should: its JSON is broken, or its plan is. Of lines that are not ``wanted``
    only the JSON is read.
    """
    # Plans hold no cycles: without this, the search for some takes a third of the time.
    collects = gc.isenabled()
    gc.disable()
    try:
        return _flatten(lines, wanted)
    finally:
        if collects:
            gc.enable()


def _flatten(lines: pa.Array, wanted: pa.Array | None) -> pa.Array:
    plans, problems, executions = _Plans(), [], []
    # What is in the plans: nothing in the first, which stands for all lines without one.
    names, marks, told = [()], {mark: [False] for mark in PLAN_MARKS}, []
    for line, unfold in zip(lines.to_pylist(), repeat(True) if wanted is None else wanted.to_pylist()):
        root = execution = problem = None
        if line is None:
            # Most lines of a log hold no plan.
            plans.plan_at.append(plans.plan_at[-1])
            told.append(0)
            problems.append(None)
            executions.append(None)
            continue
        try:
            event = _loads(line or "null")
            if event is not None:
                if not isinstance(event, dict):
                    raise ValueError("the line is not an object")
                execution, root = _whole(event.get("executionId"), "executionId"), event.get("sparkPlanInfo")
        except (ValueError, LookupError, TypeError):
            problem = BROKEN_JSON
        first = plans.plan_at[-1]
        try:
            plans.add(root if unfold else None)
        except ValueError:
            problem = BROKEN_PLAN
            plans.add(None)
        texts = "\n".join(filter(None, plans.columns["simple_string"][first:]))
        for mark, text in PLAN_MARKS.items():
            marks[mark].append(text in texts)
        told.append(len(names))
        names.append(sorted(set(filter(None, plans.columns["node_name"][first:]))))
        problems.append(problem)
        executions.append(execution)
    told = pa.array(told, pa.int32())
    return pa.StructArray.from_arrays(
        [
            pa.array(problems, pa.string()),
            pa.array(executions, pa.int64()),
            plans.nodes(),
            pa.array(names, pa.list_(pa.string())).take(told),
            pa.StructArray.from_arrays([pa.array(marks[m], pa.bool_()).take(told) for m in PLAN_MARKS], list(PLAN_MARKS)),
        ],
        FLAT_TYPE.names,
    )


# Not declared for randomness, but so that Catalyst never copies the call into a filter it pushes down (an
# unfolded array alone makes it infer one), which would unfold every plan twice.
flatten_plan = flatten_plan.asNondeterministic()

# Ship the helper with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
