import json
import os
import subprocess
import sys
from decimal import Decimal

import pytest
import zstandard
from pyspark.sql import functions as F

from conftest import LINES_SCHEMA, app, driver, end, start
from plansieve.operators import context, detectors
from plansieve.operators.findings import finding_blocks, unique_by_sql
from plansieve.operators.narrow import keep_needed
from plansieve.operators.tables import audit_tables
from plansieve.session import scratch_path
from plansieve.sinks.files import read_findings, save_findings
from plansieve.sinks.jdbc import jdbc_options, write_jdbc
from plansieve.sources import console
from plansieve.sources import lines as L
from plansieve.sources.decode import EventTables

DAY = 86_400_000
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def write(path, events, compress=False, mtime_ms=None):
    text = "".join((e if isinstance(e, str) else json.dumps(e, separators=(",", ":"))) + "\n" for e in events).encode()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(zstandard.compress(text) if compress else text)
    if mtime_ms is not None:
        os.utime(path, (mtime_ms / 1000, mtime_ms / 1000))


def test_day_windows_are_half_open(spark):
    now = 100 * DAY
    times = {0: now, 1: now - 1, 2: now - DAY, 3: now - DAY - 1, 4: now - 7 * DAY, 5: now - 7 * DAY - 1, 6: now - 30 * DAY}
    files = spark.createDataFrame([(f"application_{i}", t) for i, t in times.items()], "name STRING, mtime_ms BIGINT")
    found = {r.name[-1]: r.day_before for r in L.in_window(files, now).collect()}
    assert found == {"1": 0, "2": 0, "3": 1, "4": 6}
    assert L.in_window(files, now, days=31).count() == 6
    assert L.in_window(files, None).count() == 7


def test_a_manifest_grows_by_what_is_new(spark, tmp_path):
    d, m, now = str(tmp_path / "logs"), str(tmp_path / "manifest"), 1_700_000_000_000
    write(f"{d}/application_1", ["a"], mtime_ms=now - 5 * DAY)
    write(f"{d}/application_2", ["b"], mtime_ms=now - DAY)
    write(f"{d}/application_3.inprogress", ["c"], mtime_ms=now - 5)
    assert L.read_manifest(spark, m) is None
    assert {(r.name, r.length) for r in L.update_manifest(spark, d, m).collect()} == {("application_1", 2), ("application_2", 2)}
    write(f"{d}/application_2", ["b", "more"], mtime_ms=now - 7)
    write(f"{d}/application_4", ["d"], mtime_ms=now - 6)
    logs = L.update_manifest(spark, d, m)
    assert {(r.name, r.length) for r in logs.collect()} == {("application_1", 2), ("application_2", 7), ("application_4", 2)}
    assert spark.read.parquet(m).count() == 4  # the second listing added two entries
    for group in (1, 100):
        read = L.read_logs(L.in_window(logs, now, days=2), group=group)
        assert sorted((r.log_name, r.day_before, r.value) for r in read.collect()) == [("application_2", 0, "b"), ("application_2", 0, "more"), ("application_4", 0, "d")]


def test_lines_of_many_files_are_stored_some_files_at_a_time(spark, tmp_path, monkeypatch):
    d = str(tmp_path / "logs")
    for i in range(23):
        write(f"{d}/application_{i}", [f"{i} a", f"{i} b"])
    conf = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism")}
    # The listing is a stored table, and what is read later no longer names the logs.
    assert not any(d in f for f in L.log_files(spark, d).inputFiles())
    rows = {}
    for unread in (5, 100):
        monkeypatch.setattr(L, "FILES_UNREAD", unread)
        read = L.read_logs(L.finished_logs(L.log_files(spark, d)), group=3)
        rows[unread] = sorted((r.log_name, r.ord, r.value) for r in read.collect())
        assert any(d in f for f in read.inputFiles()) == (unread == 100)
    first, whole = ([(name, value) for name, _, value in rows[k]] for k in (5, 100))
    assert first == whole and len(whole) == 46
    assert all(a[2].endswith("a") and a[1] < b[1] for r in rows.values() for a, b in zip(r[::2], r[1::2]))
    assert conf == {k: spark.conf.get(k) for k in conf}
    # A codec that cannot be read is refused before any line is read, however late it comes.
    monkeypatch.setattr(L, "FILES_UNREAD", 5)
    write(f"{d}/application_9.lz4", ["x"])
    monkeypatch.setattr(L, "scratch_path", lambda _, name: str(tmp_path / name))
    with pytest.raises(ValueError, match="lz4"):
        L.read_logs(L.finished_logs(L.log_files(spark, d)), group=3)
    assert not (tmp_path / "lines").exists()


def test_a_scan_of_many_small_files_has_few_tasks(spark, tmp_path):
    for i in range(300):
        write(str(tmp_path / f"logs/application_{i}"), ["x"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        stored = L.log_files(spark, str(tmp_path / "logs"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # A stored file for each task that listed some; two files at most a task of 16 MB would be 150 and more at Spark's 4 MB a file.
    assert stored.count() == 300 and len(stored.inputFiles()) <= 32


def test_listing_and_reading(spark, tmp_path):
    d, now = str(tmp_path / "logs"), 1_700_000_000_000
    write(f"{d}/application_2", [app("x2"), start(1, "plain")], mtime_ms=now - 1000)
    write(f"{d}/application_1.zstd", [app("x1"), start(1, "zipped"), end(1, 9000)], compress=True, mtime_ms=now - DAY - 5)
    write(f"{d}/application_3", [app("x3"), start(1, "old")], mtime_ms=now - 9 * DAY)
    write(f"{d}/application_4.inprogress", [app("x4")], mtime_ms=now - 1000)
    write(f"{d}/other_5", [app("x5")], mtime_ms=now - 1000)
    listed = L.list_logs(spark, d, now).collect()
    assert [(r.name, r.day_before) for r in listed] == [("application_1.zstd", 1), ("application_2", 0)]
    tables = EventTables.from_lines(L.read_log_lines(spark, d, now_ms=now))
    assert {r.app_id for r in context.applications(tables).collect()} == {"x1", "x2"}
    assert {(r.sql, r.duration_ms) for r in context.sql_executions(tables).collect()} == {("plain", None), ("zipped", 7000)}
    everything = L.read_log_lines(spark, d)
    assert everything.select("log_id").distinct().count() == 3
    one = L.read_log_lines(spark, f"{d}/application_2")
    assert [(r.log_name, r.log_id[-len(d) - 14 :]) for r in one.collect()] == [("application_2", f"{d}/application_2")] * 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        L.read_log_lines(spark, f"{d}/none")


def test_unreadable_codec_stops_with_a_clear_error_if_it_would_be_read(spark, tmp_path):
    now = 1_700_000_000_000
    write(str(tmp_path / "logs/application_1.lz4"), ["x"], mtime_ms=now - 300 * DAY)
    write(str(tmp_path / "logs/application_2"), ["y"], mtime_ms=now - 1)
    with pytest.raises(ValueError, match="codec"):
        L.read_log_lines(spark, str(tmp_path / "logs"))
    assert [r.value for r in L.read_log_lines(spark, str(tmp_path / "logs"), now_ms=now).collect()] == ["y"]


def test_a_rolled_log_is_read_whole_or_not_at_all(spark, tmp_path):
    d, now = str(tmp_path / "logs"), 1_700_000_000_000
    log = f"{d}/eventlog_v2_application_9"
    write(f"{log}/events_1_application_9", [app("x9"), start(1, "q")], mtime_ms=now - 8 * DAY)
    write(f"{log}/events_2_application_9", [end(1, 9000)], mtime_ms=now - DAY - 1)
    write(f"{log}/appstatus_application_9", [], mtime_ms=now - 1)
    write(f"{d}/eventlog_v2_application_8/events_1_application_8", [app("x8")], mtime_ms=now - 1)
    write(f"{d}/eventlog_v2_application_8/appstatus_application_8.inprogress", [], mtime_ms=now - 1)
    [listed] = L.list_logs(spark, d, now).collect()
    assert (listed.name, listed.n_files, listed.day_before) == ("eventlog_v2_application_9", 2, 1)
    lines = L.read_log_lines(spark, d, now_ms=now)
    assert {(r.log_id, r.day_before) for r in lines.select("log_id", "day_before").collect()} == {(listed.log_id, 1)}
    tables = EventTables.from_lines(lines)
    assert [r.app_id for r in context.applications(tables).collect()] == ["x9"]
    assert [(r.sql, r.end_ms) for r in context.sql_executions(tables).collect()] == [("q", 9000)]
    assert L.read_log_lines(spark, d, now_ms=now, days=1).count() == 0


def test_logs_of_one_name_stay_apart(spark, tmp_path):
    for c in ("c1", "c2"):
        write(str(tmp_path / f"logs/{c}/application_1"), [app(c), driver(1, (5, int(c[1])))])
    tables = EventTables.from_lines(L.read_log_lines(spark, str(tmp_path / "logs")))
    assert {r.app_id for r in context.applications(tables).collect()} == {"c1", "c2"}
    assert sorted(r.value for r in context.metrics(tables).collect()) == [1, 2]


def test_rolled_logs_are_one_log_in_part_order(spark, tmp_path):
    d = str(tmp_path / "logs/eventlog_v2_application_9")
    for part in (1, 2, 10, 11):
        write(f"{d}/events_{part}_application_9", [driver(1, (5, part))])
    write(f"{d}/appstatus_application_9", [])
    tables = EventTables.from_lines(L.read_log_lines(spark, str(tmp_path / "logs")))
    assert [(r.log_id.rpartition("/")[2], r.value) for r in context.metrics(tables).collect()] == [("eventlog_v2_application_9", 11)]


def test_order_survives_splitting_one_large_file(spark, tmp_path):
    path = str(tmp_path / "logs/application_1")
    write(path, [driver(1, (i % 7, i)) for i in range(4000)])
    keys = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        lines = L.read_log_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 8
        ordered = [r.value for r in lines.orderBy("ord").collect()]
        values = {r.accumulator_id: r.value for r in context.metrics(EventTables.from_lines(lines)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert ordered == [line.rstrip("\n") for line in open(path)]
    assert values == {i % 7: i for i in range(3993, 4000)}


def test_only_files_in_the_window_are_opened(spark, tmp_path):
    d, now = str(tmp_path / "logs"), 1_700_000_000_000
    for i in range(5):
        write(f"{d}/application_{i}", ["x"], mtime_ms=now - i * DAY - 1)
    lines = L.read_log_lines(spark, d, now_ms=now, days=2).select("value")
    assert lines.count() == 2
    lines.collect()

    def leaves(node):
        children = [node.children().apply(k) for k in range(node.children().size())]
        return [leaf for c in children for leaf in leaves(c)] if children else [node]

    assert sum(x.metrics().get("numFiles").get().value() for x in leaves(lines._jdf.queryExecution().executedPlan())) == 2


def test_console_output(spark, tmp_path):
    listed = [
        "LogLength:5", "", "  \t", "End of LogType:stdout", "****************************", "LogContents:",
        "__BLOCKSTART__URL", "u1", "__BLOCKEND__URL", "noise", "__BLOCKSTART__SQL", "select", "1", "__BLOCKEND__SQL",
        "__BLOCKSTART__PLANCOST", "x", "__BLOCKEND_PLANCOST",
        "__BLOCKSTART__URL", "u2", "__BLOCKEND__URL", "__BLOCKSTART__SQL", "select", "1", "__BLOCKEND__SQL",
        "__BLOCKSTART__SQL", "__BLOCKEND__SQL", "__BLOCKSTART__SQL", "select 2", "__BLOCKEND__SQL", "__BLOCKSTART__SQL", "open",
    ]
    write(str(tmp_path / "out/container_1/stdout"), listed)
    write(str(tmp_path / "out/container_2/stdout"), ["__BLOCKSTART__SQL", "select 3", "__BLOCKEND__SQL"])
    lines = console.read_output(spark, str(tmp_path / "out"))
    assert lines.count() == len(listed) - 6 + 3
    for chunk_rows in (2, 1000):
        blocks = console.parse_findings(lines, chunk_rows).orderBy("log_id", "block_no").collect()
        assert [(r.sql, r.url) for r in blocks] == [("select\n1", "u1"), ("select\n1", "u2"), ("select 2", "u2"), ("select 3", None)]
    unique = {r.sql: (r.url, r.occurrences) for r in unique_by_sql(console.parse_findings(lines)).collect()}
    assert unique == {"select\n1": ("u2", 2), "select 2": ("u2", 1), "select 3": (None, 1)}


def test_findings_round_trip_as_blocks_and_files(spark, tmp_path):
    found = spark.createDataFrame(
        [("d", "a", 1, "u", "s1\ns2", {"x": "1", "y": "2"}), ("d", "a", 1, "u", "s1\ns2", {"y": "2", "x": "1"}), ("e", "a", 1, "u", "s", {"x": "1"})],
        "detector STRING, log_id STRING, execution_id BIGINT, url STRING, sql STRING, detail MAP<STRING,STRING>",
    )
    path = str(tmp_path / "findings")
    save_findings(found, path)
    assert sorted((r.detector, r.detail["x"]) for r in read_findings(spark, path).collect()) == [("d", "1"), ("e", "1")]
    text = finding_blocks(found).select("log_id", F.posexplode(F.split("value", "\n")).alias("i", "value"), "execution_id")
    lines = text.filter("value <> ''").withColumn("ord", F.monotonically_increasing_id().cast("decimal(38,0)"))
    assert sorted(r.sql for r in console.parse_findings(lines).collect()) == ["s", "s1\ns2", "s1\ns2"]


def test_blocks_of_an_unknown_application_and_of_a_killed_container(spark):
    found = spark.createDataFrame(
        [("d", "a", 1, "u1", "s1", {}), ("d", "a", 2, None, "s2", {"plan_cost": "tree"})],
        "detector STRING, log_id STRING, execution_id BIGINT, url STRING, sql STRING, detail MAP<STRING,STRING>",
    )
    text = finding_blocks(found).orderBy("execution_id").select("log_id", F.posexplode(F.split("value", "\n")).alias("i", "value"), "execution_id")
    order = (F.col("execution_id") * 100 + F.col("i")).cast("decimal(38,0)")
    lines = text.select("log_id", order.alias("ord"), "value")
    cut = spark.createDataFrame([("a", 900 + k, v) for k, v in enumerate(["__BLOCKSTART__SQL", *["x"] * 50])], "log_id STRING, ord LONG, value STRING")
    lines = lines.union(cut.select("log_id", F.col("ord").cast("decimal(38,0)"), "value"))
    assert sorted((r.sql, r.url) for r in console.parse_findings(lines).collect()) == [("s1", "u1"), ("s2", None)]
    assert "__BLOCKSTART__PLANCOST\ntree\n__BLOCKEND__PLANCOST" in finding_blocks(found).filter("execution_id = 2").first().value


def test_needed_keys_filter_at_any_size(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    few = spark.createDataFrame([(1,), (5,), (None,)], "k BIGINT")
    assert sorted(r.k for r in keep_needed(rows, few).collect()) == [1, 5]
    many = spark.range(5, 300_000).withColumnRenamed("id", "k")
    assert keep_needed(rows, many).count() == 995
    assert keep_needed(rows, None).count() == 1000


def test_table_audit(spark, tmp_path):
    root, away = str(tmp_path / "wh"), str(tmp_path / "away")
    spark.range(10).repartition(2).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(f"{root}/full")
    spark.range(5).coalesce(1).write.parquet(f"{root}/full_too")
    spark.range(5).coalesce(1).write.parquet(f"{away}/t")
    spark.range(5).coalesce(1).write.parquet(f"{away}/t/inner")
    os.makedirs(f"{root}/bare")
    spark.sql(f"CREATE DATABASE audit_t LOCATION '{root}'")
    places = {"full": f"{root}/full", "full_too": f"{root}/full_too", "gone": f"{root}/gone", "bare": f"{root}/bare", "outer_t": f"{away}/t", "inner_t": f"{away}/t/inner", "lost": f"{away}/t/lost"}
    for t, place in places.items():
        spark.sql(f"CREATE TABLE audit_t.{t} (id BIGINT) USING parquet LOCATION '{place}'")
    found = {r.table: r for r in audit_tables(spark, ["audit_t"]).collect()}
    assert (found["full"].n_folders, found["full"].missing) == (2, False)
    assert found["full"].bytes > 0 and found["full"].provider.lower() == "parquet" and found["full"].newest is not None
    assert (found["gone"].n_files, found["gone"].bytes, found["gone"].missing) == (0, 0, True)
    assert (found["bare"].n_files, found["bare"].missing) == (0, False)

    def on_disk(place):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(place) for f in names if f.startswith("part-"))

    for t in ("full", "full_too", "inner_t"):
        assert found[t].bytes == on_disk(places[t])
    # A file counts for the table whose folder is nearest.
    assert found["outer_t"].bytes == on_disk(places["outer_t"]) - on_disk(places["inner_t"])
    assert (found["outer_t"].n_files, found["inner_t"].n_files, found["lost"].missing) == (1, 1, True)


def test_default_and_nested_databases_count_each_file_once(spark):
    spark.sql("CREATE DATABASE nested_d")
    spark.range(3).coalesce(1).write.saveAsTable("nested_d.t")
    spark.range(3).coalesce(1).write.saveAsTable("default.plain_t")
    try:
        found = {(r.db, r.table): r for r in audit_tables(spark).collect()}
        assert found["nested_d", "t"].n_files == found["default", "plain_t"].n_files == 1
    finally:
        spark.sql("DROP DATABASE nested_d CASCADE")
        spark.sql("DROP TABLE default.plain_t")


def test_jdbc_options(tmp_path):
    path = tmp_path / "sink.properties"
    path.write_text("# sinks\nmine.driver=org.x.Driver\nmine.url = jdbc:x:mem;a=b\nmine.username=u\nmine.password=p=1\nother.url=jdbc:y\n")
    assert jdbc_options(str(path), "mine") == {"driver": "org.x.Driver", "url": "jdbc:x:mem;a=b", "user": "u", "password": "p=1"}
    assert jdbc_options(str(path), "other") == {"url": "jdbc:y"}
    with pytest.raises(KeyError):
        jdbc_options(str(path), "none")


class FakeDatabase:
    """Stands in for a connection: no database is started for these tests."""

    def __init__(self, fails_on=None):
        self.said, self.fails_on = [], fails_on

    def connect(self, spark, options):
        self.said.append(f"connect {options['url']}")
        return self

    def setAutoCommit(self, on):
        assert on is False

    def createStatement(self):
        return self

    def executeUpdate(self, sql):
        self.said.append(sql)
        if self.fails_on and sql.startswith(self.fails_on):
            raise RuntimeError("refused")

    def commit(self):
        self.said.append("commit")

    def rollback(self):
        self.said.append("rollback")

    def close(self):
        pass


@pytest.mark.parametrize("fails_on", [None, "INSERT", "save"])
def test_jdbc_write_is_parallel_and_whole(spark, monkeypatch, fails_on):
    seen, db = [], FakeDatabase(fails_on)

    def save(writer, *args, **kwargs):
        seen.append(writer._df.rdd.getNumPartitions())
        if fails_on == "save":
            raise RuntimeError("lost a task")

    def options(writer, **given):
        seen.append(given["dbtable"])
        return writer

    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.save", save)
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.options", options)
    df = spark.range(0, 100, 1, 5).withColumn("a b", F.lit(1))
    if fails_on is None:
        write_jdbc(df, {"url": "jdbc:x"}, "t", connect=db.connect)
        assert seen == ["t", 5] and not db.said
        seen.clear()
        write_jdbc(df, {"url": "jdbc:x"}, "t", atomic=True, connect=db.connect)
    else:
        with pytest.raises(RuntimeError):
            write_jdbc(df, {"url": "jdbc:x"}, "t", atomic=True, connect=db.connect)
    staging = seen[0]
    assert staging.startswith("t_staging_") and seen[1] == 5
    moved = ["connect jdbc:x", f'INSERT INTO t ("id", "a b") SELECT "id", "a b" FROM {staging}', "rollback" if fails_on else "commit"]
    dropped = ["connect jdbc:x", f"DROP TABLE IF EXISTS {staging}", "commit"]
    assert db.said == ([] if fails_on == "save" else moved) + dropped


def test_options_of_the_job():
    from plansieve.job import parse_options

    given = ["node_name.node_name=Expand", "schedule_delay.threshold_ms=5", "uneven_shuffle.parents=SortMergeJoin,SortMergeJoin(skew=true)"]
    assert parse_options(given) == {
        "node_name": {"node_name": "Expand"}, "schedule_delay": {"threshold_ms": 5},
        "uneven_shuffle": {"parents": ("SortMergeJoin", "SortMergeJoin(skew=true)")},
    }
    for wrong in ("node_name", "none.x=1", "node_name.child=1", "schedule_delay.threshold_ms=x"):
        with pytest.raises(ValueError):
            parse_options([wrong])


OWN_APP = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2]").appName("own").config("spark.ui.enabled", "false")
    .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", sys.argv[1]).config("spark.eventLog.compress", sys.argv[2])
    .config("spark.eventLog.rolling.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    .config("spark.sql.autoBroadcastJoinThreshold", "-1").getOrCreate())
spark.sparkContext.setJobGroup("my-query", "join by key")
a = spark.range(1000).withColumn("s", F.col("id").cast("string"))
b = spark.range(500).withColumnRenamed("id", "k").withColumn("t", F.col("k").cast("string"))
a.join(b, a.id == b.k).groupBy("t").count().collect()
spark.sparkContext.setJobGroup("my-like", "join by like")
a.join(F.broadcast(b), F.expr("s LIKE concat(t, '%')")).count()
spark.stop()
"""


@pytest.mark.parametrize("compress", ["true"])
def test_log_written_by_spark_itself(spark, tmp_path, compress):
    d = str(tmp_path / "own")
    os.makedirs(d)
    script = tmp_path / "own.py"
    script.write_text(OWN_APP)
    subprocess.run([sys.executable, str(script), d, compress], check=True, timeout=180, capture_output=True)
    tables = EventTables.from_lines(L.read_log_lines(spark, d, file_glob="local-*"))
    found = detectors.nested_loop_matches(tables).collect()
    assert len(found) == 1 and found[0].kind == "LIKE" and found[0].query_id == "my-like" and found[0].sql == "join by like"
    assert found[0].end_ms > found[0].start_ms
    assert {r.app_name for r in context.applications(tables).collect()} == {"own"}
    metrics = context.metrics(tables)
    from plansieve.plans import cost, tree

    updates = tree.plan_updates(tables).filter("is_final")
    trees = tree.plan_trees(updates)
    costs = cost.plan_cost(trees, metrics)
    joins = {r.node_name: r.rows for r in cost.cost_nodes(costs).filter(F.col("node_name").endswith("Join")).collect()}
    assert joins["SortMergeJoin"] == 500
    assert tables.corrupt().count() == 0
    assert detectors.task_ends(tables).count() > 4


def test_scratch_paths_are_fresh(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert spark.createDataFrame([("a", Decimal(1), "v")], LINES_SCHEMA).count() == 1


def test_job_writes_findings_by_day(spark, tmp_path):
    from conftest import node, update
    from plansieve.job import analyse

    d, out, now = str(tmp_path / "logs"), str(tmp_path / "out"), 1_700_000_000_000
    like = node("BroadcastNestedLoopJoin", "BroadcastNestedLoopJoin BuildRight, Inner, a#1 LIKE b#2")
    for k in (1, 2):
        write(f"{d}/application_{k}", [app(f"x{k}"), start(1, f"q{k}"), update(1, like), update(1, like), end(1)], mtime_ms=now - k * DAY + 5)
    analyse(spark, d, out, now, 3, ["nested_loop_string_match"])
    assert sorted((r.day_before, r.sql) for r in spark.read.parquet(out).collect()) == [(0, "q1"), (1, "q2")]


def test_the_listing_query_runs_the_rule_of_the_listing(spark, monkeypatch):
    from plansieve import checks

    called = []
    rule = L.finished_logs
    monkeypatch.setattr(L, "finished_logs", lambda *a, **k: called.append(1) or rule(*a, **k))
    assert checks.list_logs_by_day(spark, "/root/testdata/sf0.001").columns == ["name", "mtime_ms", "day_before"] and called
