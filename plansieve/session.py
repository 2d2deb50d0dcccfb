"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the jobs rely on; anything the caller or the cluster sets wins.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Events are saved by kind: keep one writer per kind open, and spare each task a sort by kind.
    "spark.sql.maxConcurrentOutputFileWriters": "16",
    # Plan lines can be megabytes each: bound the Arrow batches by bytes as well as by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` overrides them (``**{"spark.x.y": "z"}``)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the setting is absent (a local test session) is a fresh local folder made and
    remembered in the session, so later calls agree.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("plansieve.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set("plansieve.scratch.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the scratch folder that no earlier run has used."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
