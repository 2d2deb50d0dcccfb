"""Compare every registered query with its SQL on DuckDB: ``python tests/verify.py [sf_dir] [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from plansieve.session import build_session  # noqa: E402


def normal(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


def compare(spark, con, name, sf_dir):
    """(problem or None, row count, seconds) of one query."""
    begun = time.time()
    df = entry.queries()[name](spark, sf_dir)
    found = df.collect()
    took = time.time() - begun
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "no oracle", len(found), took
    cursor = con.execute(sql)
    want, want_names = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    got, got_names = rows_of(df.columns, [tuple(r) for r in found])
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got), took
    if len(got) != len(want):
        return f"{len(got)} rows, wanted {len(want)}", len(got), took
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return (f"{len(bad)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}" if bad else None), len(got), took


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("verify", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in sys.argv[2:] or entry.queries():
        try:
            problem, n, took = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            problem, n, took = f"{type(e).__name__}: {str(e)[:600]}", 0, 0.0
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28} {n:8} rows {took:7.2f} s {problem or ''}", flush=True)
    print(f"{failed} failed")
    sys.exit(failed > 0)


if __name__ == "__main__":
    main()
