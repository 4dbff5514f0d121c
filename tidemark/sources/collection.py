"""Collections of vectors: created with a width, written in batches, loaded whole, thinned by source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vector import check_dim
from . import files, tables
from .tables import Buckets


@dataclass(frozen=True)
class Collection:
    """Rows (id, content, metadata as JSON text, embedding of dim numbers) in buckets of their id."""

    root: str
    dim: int
    buckets: int

    @property
    def table(self) -> Buckets:
        return Buckets(f"{self.root}/rows", ("id",), self.buckets)

    def write(self, rows: DataFrame) -> None:
        """Insert a batch or, on equal id, replace; ids of a batch are distinct. A vector of another width fails the batch, which then changes nothing."""
        self.table.upsert(check_dim(rows.select("id", "content", "metadata", "embedding"), "embedding", self.dim))

    def load(self, spark: SparkSession) -> DataFrame:
        if not tables.exists(spark, self.table.root):
            return spark.createDataFrame([], "id long, content string, metadata string, embedding array<double>")
        return self.table.read(spark)

    def delete_source(self, spark: SparkSession, source: str) -> int:
        """Delete the rows whose metadata names a source, rewriting only their buckets: how many."""
        if not tables.exists(spark, self.table.root):
            return 0
        rows = spark.read.parquet(self.table.root)
        gone = F.get_json_object("metadata", "$._source") == source
        met = {r["bucket"]: r["count"] for r in rows.where(gone).groupBy("bucket").count().collect()}  # a row per bucket
        full = {r["bucket"]: r["count"] for r in rows.where(F.col("bucket").isin(sorted(met))).groupBy("bucket").count().collect()}
        left = files.delete_by_source(rows.where(F.col("bucket").isin(sorted(met))).drop("bucket"), source)
        self.table.write(left)
        for bucket in (b for b, n in met.items() if n == full[b]):  # nothing is left to put in its place
            tables.remove(spark, f"{self.table.root}/bucket={bucket}")
        return sum(met.values())


def create(spark: SparkSession, root: str, dim: int, buckets: int = 256) -> Collection:
    """The collection at root, made if there is none; one of another width is an error."""
    if not tables.claim(spark, f"{root}/collection", f"{dim} {buckets}"):
        known, buckets = map(int, tables.told(spark, f"{root}/collection").split())
        if known != dim:
            raise ValueError(f"{root} holds vectors of {known} numbers, not {dim}")
    return Collection(root, dim, buckets)
