"""Databases: scans that read each row once in parallel ranges, and loads that can be repeated."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _options(url: str, driver: str | None) -> dict[str, str]:
    return {"url": url} | ({"driver": driver} if driver else {})


def range_predicates(low: int | None, high: int | None, column: str, parts: int) -> list[str]:
    """Conditions that every row meets exactly one of: half-open ranges from low to high, open at both ends, nulls in the first."""
    if low is None or high is None or parts < 2 or high <= low:
        return ["1 = 1"]
    cuts = sorted({low + (high - low + 1) * k // parts for k in range(1, parts)} - {low})
    ends = [None, *cuts, None]
    out = []
    for a, b in zip(ends, ends[1:], strict=False):
        terms = ([f"{column} >= {a}"] if a is not None else []) + ([f"{column} < {b}"] if b is not None else [])
        out.append(" AND ".join(terms) if a is not None else f"({' AND '.join(terms) or '1 = 1'} OR {column} IS NULL)")
    return out


def read_table(spark: SparkSession, url: str, table: str, column: str | None = None, parts: int = 8, driver: str | None = None, fetch: int = 10_000) -> DataFrame:
    """A table or query (`(SELECT ...) t`) by ranges of a whole-number column, whose least and greatest value the source is asked for first.

    Each row is read once, by one partition; rows with a null in the column go with the first. Without a column one task reads all."""
    options = _options(url, driver)
    if column is None:
        return spark.read.format("jdbc").options(**options, dbtable=table, fetchsize=str(fetch)).load()
    ends = spark.read.format("jdbc").options(**options, dbtable=f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}) ends").load().toDF("lo", "hi").first()
    low, high = (None if v is None else int(v) for v in ends)
    return spark.read.jdbc(url, table, predicates=range_predicates(low, high, column, parts), properties={"fetchsize": str(fetch)} | ({"driver": driver} if driver else {}))


def _execute(spark: SparkSession, url: str, statements: list[str]) -> None:
    """Statements in one transaction, by the driver's own connection."""
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for s in statements:
            statement.executeUpdate(s)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def load_table(df: DataFrame, url: str, table: str, batch: str, driver: str | None = None, rows: int = 10_000, types: str = "") -> None:
    """Adds df's rows to a table as one batch, whose name stands in the column load_batch. A batch that is loaded again replaces itself.

    Tasks write to a staging table, where a retried task may leave rows twice: each row carries its partition and place, and one transaction
    takes each of them once. The table is made if it isn't there. types: column types in SQL where the driver's own choice doesn't serve, such as
    VARCHAR(64) where a database compares no long texts."""
    spark = df.sparkSession
    if driver:
        spark.sparkContext._jvm.java.lang.Class.forName(driver)
    staging = f"{table}_stage_{uuid.uuid4().hex[:12]}"
    marked = df.withColumn("load_batch", F.lit(batch)).withColumn("load_row", F.monotonically_increasing_id())
    write = lambda d, name, mode: d.write.format("jdbc").options(**_options(url, driver), dbtable=name, batchsize=str(rows), createTableColumnTypes=", ".join(x for x in (types, "load_batch VARCHAR(128)") if x)).mode(mode).save()
    write(marked, staging, "errorifexists")
    try:
        if not _has(spark, url, table):
            write(marked.limit(0), table, "errorifexists")
        names = ", ".join(f'"{c}"' for c in marked.columns)
        quoted = batch.replace("'", "''")
        _execute(spark, url, [f"DELETE FROM {table} WHERE \"load_batch\" = '{quoted}'", f"INSERT INTO {table} ({names}) SELECT DISTINCT {names} FROM {staging}"])
    finally:
        _execute(spark, url, [f"DROP TABLE {staging}"])


def _has(spark: SparkSession, url: str, table: str) -> bool:
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        for name in (table, table.upper()):
            if connection.getMetaData().getTables(None, None, name, None).next():
                return True
        return False
    finally:
        connection.close()
