"""Audit of where catalog tables keep their files."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansieve.operators.narrow import stash
from plansieve.session import scratch_path


def catalog_tables(spark: SparkSession, databases: list[str] | None = None) -> DataFrame:
    """(db, table, provider, uri, is_partitioned, location) of every stored table; one metadata call per database.

    ``location`` is ``uri`` without the slashes after its scheme and at its end, of which there may be any number.
    """
    names = databases or [d.name for d in spark.catalog.listDatabases()]
    found = None
    for name in names:
        described = spark.sql(f"SHOW TABLE EXTENDED IN `{name}` LIKE '*'").filter(~F.col("isTemporary"))

        def field(label: str):
            return F.nullif(F.regexp_extract("information", rf"(?m)^{label}: (.*)$", 1), F.lit(""))

        rows = described.select(
            F.col("namespace").alias("db"),
            F.col("tableName").alias("table"),
            field("Provider").alias("provider"),
            field("Location").alias("uri"),
            (field("Partition Provider") == "Catalog").alias("is_partitioned"),
            F.regexp_replace(field("Location"), r"^([a-z0-9]+:)/*|/+$", "$1").alias("location"),
        )
        found = rows if found is None else found.unionByName(rows)
    return found


def _plain_location(uri: str) -> str:
    return re.sub(r"^([a-z0-9]+:)/*", r"\1", uri).rstrip("/")


def partition_locations(spark: SparkSession, tables: DataFrame) -> DataFrame:
    """(db, table, uri, location) of partitions that do not lie below their table's location; one metadata call per table.

    Only tables whose partitions the catalog keeps are asked, and only places of their own are gathered: the others are found in
    the table's own folder.
    """
    jvm = spark.sparkContext._jvm
    catalog = spark._jsparkSession.sessionState().catalog()
    found = []
    for t in tables.filter("is_partitioned AND location IS NOT NULL").select("db", "table", "location").toLocalIterator():
        name = jvm.org.apache.spark.sql.catalyst.TableIdentifier(t.table, jvm.scala.Option.apply(t.db))
        listed = catalog.listPartitions(name, jvm.scala.Option.empty()).iterator()
        while listed.hasNext():
            place = listed.next().storage().locationUri()
            if place.isDefined():
                uri = place.get().toString()
                if not f"{_plain_location(uri)}/".startswith(f"{t.location}/"):
                    found.append((t.db, t.table, uri, _plain_location(uri)))
    return spark.createDataFrame(found, "db STRING, table STRING, uri STRING, location STRING")


def _listing(spark: SparkSession, uri: str, recursive: bool) -> DataFrame | None:
    """Path, length and modification time of the files below a folder; None if there is no such folder."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(uri)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return files.select("path", "length", "modificationTime")


def _per_folder(files: DataFrame) -> DataFrame:
    path = F.regexp_replace("path", r"^([a-z0-9]+:)/*", "$1")
    return (
        files.select(F.regexp_replace(path, "/[^/]*$", "").alias("folder"), "length", "modificationTime")
        .groupBy("folder")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"))
    )


def storage_files(spark: SparkSession, uris: list[str]) -> tuple[DataFrame, set[str]]:
    """(folder, n_files, bytes, newest) below the locations, one row per folder, and the locations that do not exist.

    A location below another one is listed with that one, so every file is listed once; no file is opened. One
    location is listed at a time, and its folders are stored before the next.
    """
    plain = {_plain_location(u): u for u in uris}
    path, absent, root = scratch_path(spark, "folders"), set(), None
    spark.createDataFrame([], "folder STRING, n_files BIGINT, bytes BIGINT, newest TIMESTAMP").write.parquet(path)
    # Sorted with their closing slash, locations follow directly on the one they lie below.
    for location in sorted(plain, key=lambda x: x + "/"):
        nested = root is not None and location.startswith(root + "/")
        files = _listing(spark, plain[location], recursive=not nested)
        if files is None:
            absent.add(location)
        elif not nested:
            root = location
            _per_folder(files).write.mode("append").parquet(path)
    return spark.read.schema("folder STRING, n_files BIGINT, bytes BIGINT, newest TIMESTAMP").parquet(path), absent


def audit_tables(spark: SparkSession, databases: list[str] | None = None) -> DataFrame:
    """(db, table, provider, location, n_folders, n_files, bytes, newest, missing) for every catalog table.

    Every table's own location is listed, wherever it lies, and so are the locations of partitions that lie elsewhere. A file counts
    for its owner: the table of the longest location it lies below, so a table in another one's folder has its files for itself. Tables
    of the same location all have its files. ``missing`` tells that the table's folder does not exist; a folder without files counts 0
    files.
    """
    tables = stash(catalog_tables(spark, databases), "tables")
    owners = stash(tables.select("db", "table", "uri", "location").union(partition_locations(spark, tables)).distinct(), "owners")
    uris = [r.uri for r in owners.select("uri").filter("uri is not null").distinct().collect()]
    folders, absent = storage_files(spark, uris)
    # Listing a folder's parents turns the prefix test into an equi-join.
    parts = F.split("folder", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    locations = owners.select("location").dropna().distinct()
    below = folders.withColumn("location", F.explode(parents)).join(locations, "location")
    nearest = below.groupBy("folder").agg(F.max_by("location", F.length("location")).alias("location"))
    owned = (
        folders.join(nearest, "folder")
        .join(owners, "location")
        .groupBy("db", "table")
        .agg(
            F.count(F.lit(1)).alias("n_folders"),
            F.sum("n_files").alias("n_files"),
            F.sum("bytes").alias("bytes"),
            F.max("newest").alias("newest"),
        )
    )
    gone = spark.createDataFrame([(x, True) for x in sorted(absent)], "location STRING, missing BOOLEAN")
    return tables.join(owned, ["db", "table"], "left").join(gone, "location", "left").select(
        "db",
        "table",
        "provider",
        "location",
        F.coalesce("n_folders", F.lit(0)).alias("n_folders"),
        F.coalesce("n_files", F.lit(0)).alias("n_files"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        "newest",
        F.coalesce("missing", F.lit(False)).alias("missing"),
    )
