"""Every registered query against its SQL on the smallest test tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plansieve import checks
from verify import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(checks.QUERIES) == set(checks.ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(checks.QUERIES))
def test_query(spark, con, name):
    problem, n, _ = compare(spark, con, name, SF_DIR)
    assert problem is None
    assert n > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["list_log_files", "read_rolled_logs"])
def test_many_small_files_are_written_by_many_tasks(spark, name, tmp_path, monkeypatch):
    monkeypatch.setattr(checks, "scratch_path", lambda _, name: str(tmp_path / name))
    assert entry.queries()[name](spark, SF_DIR).count()
    assert len({p.name.split("-")[1] for p in tmp_path.glob("logs/*/part-*")}) > 1


@pytest.mark.parametrize("n", [0, 1, 100, 1001])
def test_files_of_given_size_are_written_by_many_tasks(spark, tmp_path, n):
    rows = spark.range(n).select((F.col("id") + 1).alias("no"), F.col("id").cast("string").alias("value"))
    checks._write_files(rows.repartition(3), str(tmp_path / "out"), 100)
    files = [p for p in (tmp_path / "out").glob("part-*")]
    sizes = sorted(len(p.read_text().split()) for p in files)
    assert sizes == ([n % 100] if n % 100 or not n else []) + [100] * (n // 100)
    assert sorted(int(v) for p in files for v in p.read_text().split()) == list(range(n))
    if n > 1000:
        assert len({p.name.split("-")[1] for p in files}) > 5


def test_audited_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(checks, "scratch_path", lambda _, name: str(tmp_path / name))
    assert entry.queries()["audit_table_files"](spark, SF_DIR).count() == 7
    # What lies below the database's own folder is dropped with it.
    for place in ("plain", "away", "elsewhere"):
        written = [p for p in tmp_path.glob(f"warehouse/{place}/part-*")]
        assert len(written) == len({p.name.split("-")[1] for p in written}) == 2
