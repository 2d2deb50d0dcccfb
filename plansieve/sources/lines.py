"""Finding log files, reading their lines and filtering lines by event tag."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansieve.events import COMMON_EVENT_TYPES
from plansieve.operators.narrow import stash
from plansieve.session import scratch_path

DAY_MS = 86_400_000
TAG_OPENING = '{"Event":"'

# Single-file logs are named after the application; rolled logs are a folder of numbered parts, with an empty file beside
# them that tells whether the application is still running.
LOG_FILE_GLOB = "{application_,events_}*"
ROLLED_LOG_FOLDER = r"^(.*/eventlog_v2_[^/]+)/[^/]+$"
ROLLED_PART_NUMBER = r"/events_(\d+)_[^/]*$"
LOG_FILE_NAME = r"/([^/]+)$"
RUNNING_GLOB = "appstatus_*.inprogress"

PATHS_AT_ONCE = 10_000
# The driver keeps some 2 kB for each file of a read that has not run. Lines of more files are stored, so many files after the other.
FILES_UNREAD = 20_000
# What opening a file counts as when tasks are dealt out. Spark's 4 MB would make a task of every few files of a folder of small ones.
OPEN_COST_BYTES = 16 << 10

# Written by Spark's own block codecs, which are not the codecs the text source knows by these names.
UNREADABLE_SUFFIXES = (".lz4", ".lzf", ".snappy")


def day_before(mtime_ms: Column, now_ms: int) -> Column:
    """How many whole days before ``now_ms`` a file changed: day d covers [now-(d+1) days, now-d days)."""
    return F.floor((F.lit(now_ms) - mtime_ms - 1) / F.lit(DAY_MS)).cast("int")


def _log_of(path: Column) -> Column:
    """A log's identity: the path of its file, or of its folder if it is rolled, with one slash after the scheme."""
    path = F.regexp_replace(path, "^([a-z0-9]+:)/+", "$1/")
    rolled = F.regexp_extract(path, ROLLED_LOG_FOLDER, 1)
    return F.when(rolled != "", rolled).otherwise(path)


@contextmanager
def _many_files(spark: SparkSession) -> Iterator[None]:
    """Listings and scans that run meanwhile deal many files out to few tasks; what they find is the same."""
    wanted = {
        "spark.sql.files.openCostInBytes": OPEN_COST_BYTES,
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": 4 * spark.sparkContext.defaultParallelism,
    }
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, str(value))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def log_files(spark: SparkSession, paths: str | list[str], file_glob: str = LOG_FILE_GLOB) -> DataFrame:
    """(log_id, path, length, mtime_ms, is_part, is_open) of every file of a log, from the listing alone.

    It is stored, so that the driver need not hold the listing for as long as something is asked of it.
    """

    def listing(glob: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)

    path = F.col("path")
    with _many_files(spark):
        parts = listing(file_glob).select(
            "path", "length", F.unix_millis("modificationTime").alias("mtime_ms"), F.lit(True).alias("is_part"), path.endswith(".inprogress").alias("is_open")
        )
        # The files that mark running applications are empty, and a scan passes over empty files: their names come
        # from the file index, which lists no others here.
        running = [(p, None, None, False, True) for p in listing(RUNNING_GLOB).inputFiles()]
        return stash(parts.union(spark.createDataFrame(running, parts.schema)).select(_log_of(path).alias("log_id"), "*"), "files")


def finished_logs(files: DataFrame, now_ms: int | None = None, days: int = 7) -> DataFrame:
    """(log_id, name, n_files, length, mtime_ms, day_before, paths), one row per finished log.

    A log counts as a whole: its time is that of its newest part, and all its parts come with it. A log
    with a file that is still in progress is left out. ``day_before`` is NULL without ``now_ms``.
    """
    logs = (
        files.groupBy("log_id")
        .agg(
            F.bool_or("is_open").alias("is_open"),
            F.count_if("is_part").alias("n_files"),
            F.sum(F.when(F.col("is_part"), F.col("length"))).alias("length"),
            F.max(F.when(F.col("is_part"), F.col("mtime_ms"))).alias("mtime_ms"),
            F.array_sort(F.collect_list(F.when(F.col("is_part"), F.col("path")))).alias("paths"),
        )
        .filter(~F.col("is_open") & (F.col("n_files") > 0))
        .withColumn("name", F.regexp_extract("log_id", LOG_FILE_NAME, 1))
        .drop("is_open")
    )
    return in_window(logs, now_ms, days)


def in_window(logs: DataFrame, now_ms: int | None, days: int = 7) -> DataFrame:
    """Logs of the last ``days`` days before ``now_ms``, with ``day_before``; all logs, and NULL, without ``now_ms``."""
    if now_ms is None:
        return logs.withColumn("day_before", F.lit(None).cast("int"))
    logs = logs.withColumn("day_before", day_before(F.col("mtime_ms"), now_ms))
    return logs.filter(F.col("day_before").between(0, days - 1))


MANIFEST = "log_id STRING, name STRING, n_files BIGINT, length BIGINT, mtime_ms BIGINT, paths ARRAY<STRING>"


def update_manifest(spark: SparkSession, log_dir: str | list[str], path: str, file_glob: str = LOG_FILE_GLOB) -> DataFrame:
    """List the finished logs below ``log_dir`` once and keep what was found as a table at ``path``; gives that table.

    Later calls append what they find new: logs that were not there and logs that have grown. A log's entry is its newest one.
    """
    listed = finished_logs(log_files(spark, log_dir, file_glob)).select(*[f.split()[0] for f in MANIFEST.split(", ")])
    known = read_manifest(spark, path)
    if known is not None:
        listed = listed.join(known.select("log_id", "n_files", "length", "mtime_ms"), ["log_id", "n_files", "length", "mtime_ms"], "left_anti")
    listed.select(*[f.split()[0] for f in MANIFEST.split(", ")]).write.mode("append").parquet(path)
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest entry of every log of the manifest; None if there is none yet."""
    try:
        entries = spark.read.schema(MANIFEST).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    newest = entries.groupBy("log_id").agg(F.max_by(F.struct(*entries.columns), F.struct("mtime_ms", "length", "n_files")).alias("entry"))
    return newest.select("entry.*")


def list_logs(spark: SparkSession, log_dir: str, now_ms: int, days: int = 7) -> DataFrame:
    """(log_id, name, n_files, length, mtime_ms, day_before) of the finished logs in the window, oldest first.

    These are the logs that :func:`read_log_lines` reads. File contents are never opened.
    """
    return finished_logs(log_files(spark, log_dir), now_ms, days).drop("paths").orderBy("mtime_ms", "log_id")


def line_order(part: Column, block: Column, row: Column) -> Column:
    """One sortable number for a line's place in its log: part, then byte block, then row in the block.

    The three fields sit side by side in a DECIMAL(38,0) (10, 18 and 10 digits). A fixed-width number
    keeps last-value aggregates on the hash path; a struct key would force sort aggregation.
    """
    part_weight = F.lit("1" + "0" * 28).cast("decimal(29,0)")
    block_weight = F.lit("1" + "0" * 10).cast("decimal(11,0)")
    return (
        part.cast("decimal(9,0)") * part_weight
        + block.cast("decimal(19,0)") * block_weight
        + row.cast("decimal(19,0)")
    ).cast("decimal(38,0)")


def read_log_lines(
    spark: SparkSession,
    paths: str | list[str],
    now_ms: int | None = None,
    days: int = 7,
    file_glob: str = LOG_FILE_GLOB,
    log_id_pattern: str | None = None,
    part_pattern: str = ROLLED_PART_NUMBER,
) -> DataFrame:
    """(log_id, log_name, day_before, ord, value) for every line of the finished logs below ``paths``.

    ``log_id`` is the log's path, so logs of one name in two folders stay apart; ``log_name`` is its last
    segment. With ``now_ms`` only logs of the last ``days`` days are read, each with all its parts. One
    listing decides what is read (:func:`update_manifest` keeps it for several reads). Plain files
    are split into blocks, so one huge log is read by many tasks; compressed ones are one task each, as
    their codec demands.
    """
    return read_logs(finished_logs(log_files(spark, paths, file_glob), now_ms, days), log_id_pattern, part_pattern)


def read_logs(logs: DataFrame, log_id_pattern: str | None = None, part_pattern: str = ROLLED_PART_NUMBER, group: int = PATHS_AT_ONCE) -> DataFrame:
    """The lines of chosen logs (day_before, paths); see :func:`read_log_lines`. A read names ``group`` files at most.

    Of more than ``FILES_UNREAD`` files the lines are stored in the shared scratch folder, the reads of so many files at a time: the driver
    then holds the names and the listing of these files only.
    """
    spark = logs.sparkSession
    nothing = "log_id STRING, log_name STRING, day_before INT, ord DECIMAL(38,0), value STRING"
    stored = scratch_path(spark, "lines")
    reads: list[tuple[int | None, list[str]]] = []
    n_unread, is_stored = 0, False

    def placed() -> DataFrame:
        found = None
        for day, chosen in reads:
            lines = _place_lines(spark.read.text(chosen), day, log_id_pattern, part_pattern)
            found = lines if found is None else found.unionByName(lines)
        return found

    # One file at a time comes to the driver, a day's after another's.
    files = logs.select("day_before", F.explode("paths").alias("path")).sort(F.col("day_before").asc_nulls_first(), "path")
    def refuse(f) -> None:
        if f and f.path.endswith(UNREADABLE_SUFFIXES):
            raise ValueError(f"logs use a codec the text source cannot read, e.g. {f.path}")

    for f in files.toLocalIterator():
        # Only a file that would be read is refused, and before any line is read.
        refuse(f)
        if n_unread >= FILES_UNREAD:
            if not is_stored:
                refuse(files.filter(reduce(or_, map(F.col("path").endswith, UNREADABLE_SUFFIXES))).first())
            with _many_files(spark):
                placed().write.mode("append").parquet(stored)
            reads, n_unread, is_stored = [], 0, True
        if not reads or f.day_before != reads[-1][0] or len(reads[-1][1]) >= group:
            reads.append((f.day_before, []))
        reads[-1][1].append(f.path)
        n_unread += 1
    if not reads:
        return spark.createDataFrame([], nothing)
    with _many_files(spark):
        found = placed()
        if not is_stored:
            return found
        found.write.mode("append").parquet(stored)
    return spark.read.schema(found.schema).parquet(stored)


def _place_lines(text: DataFrame, day: int | None, log_id_pattern: str | None, part_pattern: str) -> DataFrame:
    meta = F.col("_metadata")
    # The id's low 33 bits count the rows of one task, and a block is always read by one task. The id
    # must be taken before any filter; everything derived from it waits until lines have been dropped.
    placed = text.select(
        meta["file_path"].alias("path"),
        meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"),
        "value",
    )
    path = F.col("path")
    log_id = F.regexp_extract(path, log_id_pattern, 1) if log_id_pattern else _log_of(path)
    part = F.coalesce(F.regexp_extract(path, part_pattern, 1).try_cast("int"), F.lit(0))
    return placed.select(
        log_id.alias("log_id"),
        F.regexp_extract(_log_of(path), LOG_FILE_NAME, 1).alias("log_name"),
        F.lit(day).cast("int").alias("day_before"),
        line_order(part, F.col("block"), F.col("row")).alias("ord"),
        "value",
    )


def event_type_of(value: Column) -> Column:
    """The event tag when the line opens with it, else NULL.

    Only the head of the line is touched, and no regular expression runs over lines of megabytes.
    """
    start = len(TAG_OPENING) + 1
    closing = F.locate('"', value, start)
    return F.when(
        value.startswith(TAG_OPENING) & (closing > 0),
        F.substring(value, F.lit(start), closing - F.lit(start)),
    )


def has_event_type(value: Column, event_type: str) -> Column:
    """Whether the event tag of a line is ``event_type``: a comparison of bytes, cheaper than taking the tag out."""
    return value.startswith(f'{TAG_OPENING}{event_type}"')


def filter_event_types(lines: DataFrame, event_types: Iterable[str] = COMMON_EVENT_TYPES) -> DataFrame:
    """Add ``event_type`` and keep the named types; an empty set keeps every tagged line."""
    wanted = sorted(event_types)
    tagged = lines.withColumn("event_type", event_type_of(F.col("value")))
    return tagged.filter(F.col("event_type").isin(wanted) if wanted else F.col("event_type").isNotNull())


def search_lines(lines: DataFrame, needle: str) -> DataFrame:
    """The distinct lines of each log that contain ``needle``, whatever their event type."""
    return lines.filter(F.col("value").contains(needle)).select("log_id", "value").dropDuplicates()
