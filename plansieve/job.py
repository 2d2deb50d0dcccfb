"""Run detectors over a folder of logs::

    spark-submit plansieve/job.py LOG_DIR OUTPUT [--days 7] [--detectors a,b] [--option DETECTOR.NAME=VALUE ...] [--manifest PATH]

Findings are written as parquet, one folder per day before now, each finding once.
"""

from __future__ import annotations

import argparse
import inspect
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansieve.operators.detectors import DETECTORS, run_detectors
from plansieve.operators.narrow import stash
from plansieve.session import build_session, scratch_path
from plansieve.sources.decode import EventTables
from plansieve.sources.lines import in_window, read_logs, update_manifest


def analyse(
    spark: SparkSession, log_dir: str, output: str, now_ms: int, days: int, detectors: list[str] | None = None, manifest: str | None = None, **options: dict
) -> None:
    """Findings of the detectors over the logs of the last ``days`` days, written by day.

    The folder is listed once for all days. Each day is a run of its own over its own logs, so a day that fails leaves the days
    before it written.
    """
    logs = stash(in_window(update_manifest(spark, log_dir, manifest or scratch_path(spark, "manifest")), now_ms, days), "logs")
    for day in range(days):
        found: DataFrame = run_detectors(EventTables.from_lines(read_logs(logs.filter(F.col("day_before") == day))), detectors, **options)
        keys = [c for c in found.columns if c != "detail"]
        entries = F.array_sort(F.map_entries("detail"))
        found.groupBy(*keys, entries.alias("entries")).count().select(*keys, F.map_from_entries("entries").alias("detail")).write.mode(
            "overwrite"
        ).parquet(f"{output}/day_before={day}")


def parse_options(given: list[str], known: dict = DETECTORS) -> dict[str, dict]:
    """``detector.name=value`` texts as arguments of detectors; values are of the type of the argument's default, else text."""
    options: dict[str, dict] = {}
    for text in given:
        place, is_set, value = text.partition("=")
        detector, _, name = place.partition(".")
        if not is_set or detector not in known:
            raise ValueError(f"not DETECTOR.NAME=VALUE of a known detector: {text}")
        parameters = list(inspect.signature(known[detector]).parameters.values())[1:]
        parameter = next((p for p in parameters if p.name == name), None)
        if parameter is None:
            raise ValueError(f"detector {detector} has no option {name}; it has {', '.join(p.name for p in parameters)}")
        if isinstance(parameter.default, int):
            value = int(value)
        elif isinstance(parameter.default, tuple):
            value = tuple(value.split(","))
        options.setdefault(detector, {})[name] = value
    return options


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("log_dir")
    parser.add_argument("output")
    parser.add_argument("--days", type=int, default=7)
    parser.add_argument("--now-ms", type=int, default=None, help="end of the newest day (default: now)")
    parser.add_argument("--detectors", default=None, help="comma-separated names (default: all that need no argument or are given one)")
    parser.add_argument("--option", action="append", default=[], metavar="DETECTOR.NAME=VALUE", help="an argument of a detector, e.g. node_name.node_name=Expand")
    parser.add_argument("--manifest", default=None, help="where the listing is kept for later runs")
    args = parser.parse_args(argv)
    options = parse_options(args.option)
    spark = build_session("log analysis")
    names = args.detectors.split(",") if args.detectors else None
    analyse(spark, args.log_dir, args.output, args.now_ms or int(time.time() * 1000), args.days, names, args.manifest, **options)


if __name__ == "__main__":
    main()
