"""Writing results to a database described in a properties file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

OPTION_NAMES = {"driver": "driver", "url": "url", "username": "user", "password": "password"}


def jdbc_options(properties_path: str, sink_id: str) -> dict[str, str]:
    """Spark JDBC options of ``<sink_id>.driver/.url/.username/.password`` in a properties file."""
    options = {}
    with open(properties_path, encoding="utf-8") as f:
        for line in f:
            line = line.strip()
            if not line or line[0] in "#!" or "=" not in line:
                continue
            name, value = (part.strip() for part in line.split("=", 1))
            owner, _, field = name.rpartition(".")
            if owner == sink_id and field in OPTION_NAMES:
                options[OPTION_NAMES[field]] = value
    if "url" not in options:
        raise KeyError(f"{properties_path} has no {sink_id}.url")
    return options


def _connect(spark: SparkSession, options: dict[str, str]):
    """A connection of the driver, for statements that move no rows through it."""
    jvm = spark.sparkContext._jvm
    if "driver" in options:
        jvm.org.apache.spark.util.Utils.classForName(options["driver"], True, True)
    given = jvm.java.util.Properties()
    for name in ("user", "password"):
        if name in options:
            given.setProperty(name, options[name])
    return jvm.java.sql.DriverManager.getConnection(options["url"], given)


def _run(connection, *statements: str) -> None:
    """The statements in one transaction: all of them take effect, or none."""
    connection.setAutoCommit(False)
    statement = connection.createStatement()
    try:
        for sql in statements:
            statement.executeUpdate(sql)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        statement.close()


def write_jdbc(df: DataFrame, options: dict[str, str], table: str, batch_size: int = 1000, atomic: bool = False, connect=_connect) -> None:
    """Append ``df`` to a table.

    Spark commits once per partition: in parallel, each partition in its own transaction. With ``atomic`` all tasks write to a
    staging table in that way, and one statement of the database moves its rows in one transaction, so the result arrives whole or not
    at all. The staging table, ``<table>_staging_<hex>``, is created by the write and dropped afterwards, also after a failure.
    """

    def append(target: str) -> None:
        df.write.format("jdbc").options(**options, dbtable=target, batchsize=str(batch_size)).mode("append").save()

    if not atomic:
        append(table)
        return
    staging = f"{table}_staging_{uuid.uuid4().hex[:12]}"
    columns = ", ".join(f'"{c}"' for c in df.columns)
    try:
        append(staging)
        connection = connect(df.sparkSession, options)
        try:
            _run(connection, f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {staging}")
        finally:
            connection.close()
    finally:
        connection = connect(df.sparkSession, options)
        try:
            _run(connection, f"DROP TABLE IF EXISTS {staging}")
        finally:
            connection.close()
