"""Ranking a linked list that is spread over the cluster: the sums of weights before each element.

Elements are dealt in ranges of a key along which neighbours in the list mostly lie close together. Every task joins the
runs it holds into single elements, which make up a shorter list, and so on, until one task's worth is left; then each
element's sum is that of its run's first element plus its place in the run. Where a round leaves more than three quarters of the
elements (the key does not follow the list), the next one tosses a coin per element instead, and each element that shows heads
takes in a successor that shows tails: a quarter of the list goes, whatever its order.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansieve.operators.narrow import stash

END = -1
LAST_ROWS = 1 << 14
MOST_ROWS = 1 << 20  # in a task's memory, some 100 bytes each
GOOD_SHRINKING = 0.75


def rows_per_task(n: int) -> int:
    return max(LAST_ROWS, min(MOST_ROWS, 16 * isqrt(n)))


def join_runs(ids: np.ndarray, following: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of its run's head, sums before it in the run, the run's successor, the run's sums) of each element at hand.

    ``weights`` has a row per kind of weight. The last two are the run's at its head, and the element's own elsewhere.
    """
    n, order = len(ids), np.argsort(ids)
    found = order[np.minimum(np.searchsorted(ids, following, sorter=order), n - 1)]
    here = np.flatnonzero(ids[found] == following)
    before = np.full(n, -1)
    before[found[here]] = here
    head, jump = np.where(before >= 0, before, np.arange(n)), before.copy()
    sums = np.where(before >= 0, weights[:, before], 0)
    while (going := np.flatnonzero(jump >= 0)).size:
        at = jump[going]
        sums[:, going] += sums[:, at]
        head[going] = head[at]
        jump[going] = jump[at]
    tails = np.setdiff1d(np.arange(n), here, assume_unique=True)
    following, total = following.copy(), weights.copy()
    following[head[tails]] = following[tails]
    total[:, head[tails]] = sums[:, tails] + weights[:, tails]
    return head, sums, following, total


def _names(weights: list[str]) -> list[str]:
    return [f"before_{w}" for w in weights]


def _runs_in_tasks(dealt: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    columns = ["id", "next", *weights, *keys]
    out = ["id", "head", *_names(weights), "next", *weights, *keys]
    schema = pa.schema([(c, pa.int64()) for c in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, pa.schema([(c, pa.int64()) for c in columns]))
        if held.num_rows:
            of = {c: held.column(c).to_numpy() for c in columns}
            head, sums, following, total = join_runs(of["id"], of["next"], np.stack([of[w] for w in weights]))
            arrays = [of["id"], of["id"][head], *sums, following, *total, *(of[k] for k in keys)]
            yield from pa.table([pa.array(a) for a in arrays], schema=schema).to_batches(100_000)

    return dealt.select(*columns).mapInArrow(run, ", ".join(f"{c} long" for c in out))


def _runs_by_coin(rows: DataFrame, keys: list[str], weights: list[str], turn: int) -> DataFrame:
    coin = F.xxhash64("id", F.lit(turn)) % 2 == 0
    successor = rows.filter(~coin).select(F.col("id").alias("taken"), F.col("next").alias("then"), *[F.col(w).alias(f"taken_{w}") for w in weights])
    met = rows.filter(coin).join(successor, F.col("next") == F.col("taken"))
    none = F.lit(None).cast("long")
    changes = met.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("id"), none.alias("into"), F.col("then"),
                    *[(F.col(w) + F.col(f"taken_{w}")).alias(f"sum_{w}") for w in weights],
                ),
                F.struct(F.col("taken").alias("id"), F.col("id").alias("into"), none.alias("then"), *[F.col(w).alias(f"sum_{w}") for w in weights]),
            )
        )
    )
    is_taken = F.col("into").isNotNull()
    return rows.join(changes, "id", "left").select(
        "id",
        F.coalesce("into", "id").alias("head"),
        *[F.when(is_taken, F.col(f"sum_{w}")).otherwise(F.lit(0).cast("long")).alias(f"before_{w}") for w in weights],
        F.coalesce("then", "next").alias("next"),
        *[F.when(is_taken, F.col(w)).otherwise(F.coalesce(f"sum_{w}", w)).alias(w) for w in weights],
        *keys,
    )


def sums_before(rows: DataFrame, keys: list[str], weights: list[str], last_rows: int = LAST_ROWS, per_task=rows_per_task) -> DataFrame:
    """id and, per weight, ``before_<weight>``: the sum of the weights of all elements before it in the list.

    ``rows``: id, next (``END`` after the last), the weights and the keys to deal by, all long. There is one list.
    """
    rows = stash(rows.select("id", "next", *weights, *keys), "list")
    n, levels, by_key = rows.count(), [], True
    if not n:
        return rows.select("id", *[F.col(w).alias(b) for w, b in zip(weights, _names(weights))])
    while n > 1:
        if n <= last_rows:
            level = _runs_in_tasks(rows.coalesce(1), keys, weights)
        elif by_key:
            level = _runs_in_tasks(rows.repartitionByRange(-(-n // per_task(n)), *keys), keys, weights)
        else:
            level = _runs_by_coin(rows, keys, weights, len(levels))
        level = stash(level, "runs")
        levels.append(level.select("id", "head", *_names(weights)))
        rows = level.filter("id = head").drop("head", *_names(weights))
        left = rows.count()
        by_key, n = not by_key or left <= GOOD_SHRINKING * n, left
    found = rows.select("id", *[F.lit(0).cast("long").alias(b) for b in _names(weights)])
    for level in reversed(levels):
        heads = found.select(F.col("id").alias("head"), *[F.col(b).alias(f"of_{b}") for b in _names(weights)])
        found = level.join(heads, "head").select("id", *[(F.col(b) + F.col(f"of_{b}")).alias(b) for b in _names(weights)])
    return found
