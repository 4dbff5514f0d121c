"""A relational store over JDBC: reads dealt out by bounds or predicates, upserts in one statement, health."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


@contextmanager
def connection(spark: SparkSession, url: str, **options: str) -> Iterator:
    """A connection of the driver, for statements that move no rows; committed at the end or rolled back."""
    properties = spark._jvm.java.util.Properties()
    for name, value in options.items():
        properties.setProperty(name, value)
    own = spark._jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        own.setAutoCommit(False)
        yield own
        own.commit()
    except BaseException:
        own.rollback()
        raise
    finally:
        own.close()


def execute(spark: SparkSession, url: str, *statements: str, **options: str) -> list[int]:
    """Rows changed by each of the statements, which take effect together or not at all."""
    with connection(spark, url, **options) as own:
        statement = own.createStatement()
        return [statement.executeUpdate(s) for s in statements]


def read(spark: SparkSession, url: str, table: str, bounds: tuple[str, int, int, int] | None = None, predicates: list[str] | None = None, **options: str) -> DataFrame:
    """A table, or a query in parentheses with a name. With bounds (column, lower, upper, parts) or predicates (conditions that
    part the rows) each part is read by a task of its own; filters and columns go to the database."""
    if predicates:
        return spark.read.jdbc(url, table, predicates=predicates, properties=options)
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if bounds:
        column, lower, upper, parts = bounds
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.load()


def append(df: DataFrame, url: str, table: str, batch: int = 1000, parts: int = 8, **options: str) -> None:
    """Insert the rows of df over at most `parts` connections; columns may be in any order."""
    df.coalesce(parts).write.format("jdbc").options(url=url, dbtable=table, batchsize=batch, **options).mode("append").save()


def upsert(df: DataFrame, url: str, table: str, key: list[str], **options: str) -> int:
    """Insert the rows of df or, on equal key, replace them; keys of df are distinct. Executors fill a staging table of the same columns,
    and one MERGE statement takes it over: readers and a failed job meet the old rows or the new ones. How many rows changed."""
    spark, staging = df.sparkSession, f"staging_{uuid.uuid4().hex[:16]}"
    quoted = [f'"{c}"' for c in df.columns]
    execute(spark, url, f"CREATE TABLE {staging} AS SELECT {', '.join(quoted)} FROM {table} WITH NO DATA", **options)
    try:
        append(df, url, staging, **options)
        same = " AND ".join(f't."{k}" = s."{k}"' for k in key)
        changed = ", ".join(f'"{c}" = s."{c}"' for c in df.columns if c not in key)
        update = f" WHEN MATCHED THEN UPDATE SET {changed}" if changed else ""
        values = ", ".join(f"s.{c}" for c in quoted)
        merge = f"MERGE INTO {table} t USING {staging} s ON {same}{update} WHEN NOT MATCHED THEN INSERT ({', '.join(quoted)}) VALUES ({values})"
        return execute(spark, url, merge, **options)[0]
    finally:
        execute(spark, url, f"DROP TABLE {staging}", **options)


def health(spark: SparkSession, url: str, probe: str = "SELECT 1", **options: str) -> DataFrame:
    """One row: healthy, error (null where the database answers the probe)."""
    try:
        with connection(spark, url, **options) as own:
            own.createStatement().executeQuery(probe).next()
        error = None
    except Py4JError as found:
        error = str(getattr(found, "java_exception", found)).splitlines()[0]
    return spark.createDataFrame([(error is None, error)], "healthy boolean, error string")
