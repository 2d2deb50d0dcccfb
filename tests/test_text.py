import pytest
from pyspark.sql import functions as F

from plansieve.functions import text
from plansieve.functions.links import execution_link, stage_link

LONG_TEXT = (
    "Exchange hashpartitioning("
    + "CASE WHEN (c#1 IN (1,2,3,4) AND (d#2 = f(x#3, y#4))) THEN concat(a#5, (b#6), ',') ELSE coalesce(e#7, (g#8)) END, " * 20
    + "z#99, 10000), true, [id=#123]"
)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t STRING").select(column(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("value", "count"),
    [
        ("Exchange hashpartitioning(a#61, 5)", 5),
        ("Exchange hashpartitioning(id#92, site#42, 10000), true, [id=#50]", 10000),
        (LONG_TEXT, 10000),
        ("Exchange hashpartitioning(o_custkey#1L, 7), ENSURE_REQUIREMENTS, [plan_id=91]", 7),
        ("no comma", 0),
        ("Exchange SinglePartition, ENSURE_REQUIREMENTS, [plan_id=1]", 0),
        ("x75)", 75),
        ("(a,\n b, 12)\n tail", 12),
        ("", 0),
        (None, None),
    ],
)
def test_hash_partition_count(spark, value, count):
    assert one(spark, text.hash_partition_count, value) == count


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("a#12L = b#7 and a#12L > c#12", "a#1 = b#2 and a#1 > c#3"),
        ("#5 #5L #5", "#1 #2 #1"),
        ("no ids", "no ids"),
        ("", ""),
        ("x#1", "x#1"),
        (None, None),
    ],
)
def test_normalize_ids(spark, value, want):
    assert one(spark, text.normalize_ids, value) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        (
            "select * from t1 where a='x''y' and b=1.5 and c = 12 and d=123L",
            "select * from t1 where a='' and b=0.0 and c = 0 and d=123L",
        ),
        ("select  a1,\n t.2x from t2 where x in (1, 22)", "select a1, t.2x from t2 where x in (0, 0)"),
        ("select 'it\\'s', 5 from t where a = 'x'", "select '', 0 from t where a = ''"),
        ("select 'it''s' || \"say \\\"7\\\"\", r'c:\\' from t", "select '' || '', '' from t"),
        ("select 1 -- it's 7\nfrom t /* 'a 3 */ where b='y'", "select 0 from t where b=''"),
        ("select `col 7`, `a``b 1` from `t 2`", "select `col 7`, `a``b 1` from `t 2`"),
        ("select 1.5E3, 2.5e-3, 1e5, .5, 1.5D, 2.5BD, 3F, 7.", "select " + ", ".join(["0.0"] * 8)),
        ("select 12L, 0x1F, 1.2.3, a.1, b1e5, x'1F', 5-3 from t1e2", "select 12L, 0x1F, 1.2.3, a.1, b1e5, x'', 0-0 from t1e2"),
        ("select 'open and 5", "select 'open and 0"),
        ("select 'é 1', é1, 日本2 from t", "select '', é1, 日本2 from t"),
        ("", ""),
        (None, None),
    ],
)
def test_without_literals(spark, value, want):
    assert one(spark, text.without_literals, value) == want


def test_fingerprint_ignores_only_constants(spark):
    a = one(spark, text.fingerprint, "select * from t where a = 1")
    assert a == one(spark, text.fingerprint, "select *  from t where a = 27")
    assert a != one(spark, text.fingerprint, "select * from t where a = 1L")


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Scan parquet db1.t1[a#1,b#2] Batched: true", ("db1", "t1")),
        ("FileScan parquet cat.db1.t1[a#1]", ("db1", "t1")),
        ("Scan parquet [a#1] file", None),
        ("Project [a#1]", None),
    ],
)
def test_scanned_table(spark, value, want):
    found = one(spark, text.scanned_table, value)
    assert (tuple(found) if found else None) == want


def test_join_parts(spark):
    found = one(spark, text.join_parts, "SortMergeJoin [a#1L, b#2], [c#3, d#4L], LeftOuter, (x#1 > y#2)")
    assert (found.name, found.left_keys, found.right_keys, found.join_type) == (
        "SortMergeJoin", ["a", "b"], ["c", "d"], "LeftOuter",
    )
    none = one(spark, text.join_parts, "BroadcastNestedLoopJoin BuildRight, Inner")
    assert (none.name, none.left_keys, none.right_keys, none.join_type) == ("", [], [], "")


def test_links(spark):
    df = spark.createDataFrame([("app_1", "", 3), ("app_1", "2", 3), ("app_1", None, 3), (None, "1", 3)], "a STRING, t STRING, e BIGINT")
    urls = [r.u for r in df.select(execution_link(F.col("a"), F.col("t"), F.col("e"), "http://b").alias("u")).collect()]
    assert urls == ["http://b/app_1/SQL/execution/?id=3", "http://b/app_1/2/SQL/execution/?id=3", "http://b/app_1/SQL/execution/?id=3", None]
    url = df.select(stage_link(F.col("a"), F.col("e"), F.lit(1), "http://b").alias("u")).first().u
    assert url == "http://b/app_1/stages/stage/?id=3&attempt=1"


@pytest.mark.parametrize(
    "value, count",
    [("f(a, 12)", 12), ("f(a, 12) x", 12), (")", 0), ("x)", 0), ("(7)", 7), ("77)", 7), (",5)", 5), ("a,\n 6)\n", 6), ("a, 1), 2)", 2), ("ü9)", 9), ("", 0), ("a, 3", 0)],
)
def test_hash_partition_count_without_patterns(spark, value, count):
    assert one(spark, text.hash_partition_count, value) == count
    plan = spark.createDataFrame([("",)], "s STRING").select(text.hash_partition_count(F.col("s")))._jdf.queryExecution().analyzed().toString()
    assert "regexp" not in plan
