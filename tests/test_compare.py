import random

from pyspark.sql import functions as F

from plansieve.operators import compare


def test_median_runs_match_sorting_on_a_hot_group(spark):
    rng = random.Random(5)
    runs = []
    for query, variant, n in (("hot", "a", 3000), ("q", "a", 3), ("q", "b", 3), ("one", "a", 1), ("even", "b", 4), ("ties", "a", 9)):
        top = 3 if query == "ties" else 20000
        runs += [(query, variant, i, rng.randrange(top), f"plan {rng.randrange(3)}") for i in range(n)]
    df = spark.createDataFrame(runs, "query STRING, variant STRING, run_no BIGINT, elapsed_ms BIGINT, plan STRING")
    found = {(r.query, r.variant): (r.n_runs, r.elapsed_ms, r.plan) for r in compare.median_runs(df).collect()}
    groups = {}
    for query, variant, _, ms, plan in runs:
        groups.setdefault((query, variant), []).append((ms, plan))
    assert found == {k: (len(v), *sorted(v)[len(v) // 2]) for k, v in groups.items()}


def test_comparison_and_changes(spark):
    runs = [
        ("q1", "noreorder", 0, 30, "Scan a#1 Join b#2"), ("q1", "noreorder", 1, 10, "Scan a#1 Join b#2"), ("q1", "noreorder", 2, 20, "Scan a#7 Join b#9"),
        ("q1", "reorder", 0, 5, "Scan a#4L Join b#5"), ("q1", "reorder", 1, 7, "Scan a#4L Join b#5"), ("q1", "reorder", 2, 6, "Scan a#4L Join b#5"),
        ("q2", "noreorder", 0, 1, "Scan a#1 Join b#2"), ("q2", "reorder", 0, 2, "Scan b#1 Join a#2"),
        ("q3", "reorder", 0, 2, "x"),
    ]
    df = spark.createDataFrame(runs, "query STRING, variant STRING, run_no BIGINT, elapsed_ms BIGINT, plan STRING")
    found = {r.query: (r.elapsed_a, r.elapsed_b, r.changed) for r in compare.comparison(df, "noreorder", "reorder").collect()}
    assert found == {"q1": (20, 6, False), "q2": (1, 2, True)}


def test_runs_from_logged_descriptions(spark):
    executions = spark.createDataFrame(
        [("a", 1, "q39b-0-reorder", 50), ("a", 2, "q39b-1-noreorder", 60), ("a", 3, "select 1", 5), ("a", 4, "q-2-reorder", None)],
        "log_id STRING, execution_id BIGINT, sql STRING, duration_ms BIGINT",
    )
    plans = executions.select("log_id", "execution_id", F.lit("p").alias("plan"))
    found = {(r.query, r.variant, r.run_no, r.elapsed_ms) for r in compare.runs_from_executions(executions, plans).collect()}
    assert found == {("q39b", "reorder", 0, 50), ("q39b", "noreorder", 1, 60)}


def test_similar_queries(spark):
    executions = spark.createDataFrame([("select 1", 10), ("select  22", 5), ("select 'x'", None), ("select 1L", 1)], "sql STRING, duration_ms BIGINT")
    found = {r.text: (r.n, r.total_ms, r.example) for r in compare.similar_queries(executions).collect()}
    assert found == {"select 0": (2, 15, "select  22"), "select ''": (1, None, "select 'x'"), "select 1L": (1, 1, "select 1L")}
