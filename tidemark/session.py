"""A session with what the engine relies on: UTC, adaptive plans, last-wins maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    wanted = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    for key, value in wanted.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tables-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names; a local one only for local sessions where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, for plans that use it several times."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else as it is: the size is checked, not assumed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def file_states(spark: SparkSession, path: str) -> tuple:
    """(path, length, time) of every file of a table, in order, without reading any."""
    found = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return tuple(sorted(tuple(r) for r in found.collect()))  # a row per file


class Kept:
    """What was built from a table's files, for as long as these are the same: one entry per session and table, built anew when a file
    is added, replaced (by a newer or an older one) or deleted."""

    def __init__(self, build: Callable[[SparkSession, str], Any]):
        self.build = build
        self.entries: dict[tuple[str, str], tuple[tuple, Any]] = {}

    def of(self, spark: SparkSession, path: str) -> Any:
        key, states = (spark.sparkContext.applicationId, path), file_states(spark, path)
        if key not in self.entries or self.entries[key][0] != states:
            self.entries[key] = states, self.build(spark, path)
        return self.entries[key][1]
