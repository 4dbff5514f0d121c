"""Continuous ingest: files in a folder become rows of a table of buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Buckets


def ingest(stream: DataFrame, table: Buckets, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Upsert all that is available in the stream into a table; a batch reads and writes only the buckets it falls in. A batch that a
    restart repeats upserts the same rows again."""

    def batch(df: DataFrame, _: int) -> None:
        table.upsert((prepare(df) if prepare else df).dropDuplicates(list(table.key)))

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The last batch's row of each key in a table that run_to_table has appended to."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in key)), "batch").alias("_r"))
    return newest.select(*key, "_r.*").drop("batch")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Drain a stream in any output mode into Parquet, batch by batch with its number."""

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_stream(spark: SparkSession, path: str, schema, pattern: str | None = None, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)
