"""Using an intermediate result to keep the rest of a job small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansieve.session import scratch_path

# Keys up to this number are sent to every executor; more of them meet their rows in a shuffle.
FEW_KEYS = 100_000


def stash(df: DataFrame, name: str) -> DataFrame:
    """Store an intermediate result in the shared scratch folder and go on from the stored copy.

    It is computed once however often it is used, survives lost executors, and has a known size.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def never_broadcast(df: DataFrame) -> DataFrame:
    """A join's side that grows with the logs. Spark knows it by the bytes of compressed files or shuffles, of which its rows
    are many times the size, and would gather it in the driver."""
    return df.hint("merge")


def are_few(needed: DataFrame) -> bool:
    """Whether keys may be sent to every executor. They are counted, so they should be stored."""
    return needed.count() <= FEW_KEYS


def keep_needed(rows: DataFrame, needed: DataFrame | None, few: bool | None = None) -> DataFrame:
    """Only the rows whose key is among ``needed``, whose columns are the key; all rows if it is None.

    Given an aggregate by that key, a small set of keys is broadcast below the aggregate, and a large one meets
    it where the aggregate has put its keys. ``needed`` is counted to tell, unless ``few`` does (:func:`are_few`).
    """
    if needed is None:
        return rows
    keys = needed.dropna().distinct()
    keys = F.broadcast(keys) if (are_few(needed) if few is None else few) else never_broadcast(keys)
    return rows.join(keys, needed.columns, "left_semi")
