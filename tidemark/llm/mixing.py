"""Mixing sources to target weights by capped water-filling.

Every source has a size (words of its texts) and a weight; together they share a budget. A
source gets its weight's share of the budget, but at most `epochs` times its size: sources
above that are clamped there and what they leave is shared among the others by weight, again
until none is above. All comparisons are between whole numbers. The sources are a table, not a
list in the driver: each round is one aggregate over it, from which two numbers come back. As a
clamped source stays clamped, there are at most as many rounds as sources, and few in practice.

A source that gets 2.3 times its size gives every text two whole repetitions, and a third one
to so many texts that 0.3 of its words are repeated. These are chosen in an order of falling
sizes with seeded ties: what is owed grows by 0.3 of each text's words, and a text is taken when what is owed
passes a seeded share of its size, which makes a text's chance 0.3 and leaves what is still owed
at about the size of the smallest texts. The rows of a source are dealt by a seeded hash into
groups of about GROUP rows, each settled on its own, so a source of any size is spread over many tasks.
Results rest on doc_id, source, size and seed alone: reruns and other partitionings agree.

Null texts have size 0. Null sources are one source of their own, the last one; an empty name
is another source. Sources of size 0 get nothing. Rows that repeat doc_id, source and size are
alike: some of them may get a repetition more than others. Other columns of docs stay untouched
in `mix` and may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import materialize

EPOCHS = 3
#: Rows of a group that one task settles in order, about.
GROUP = 1024
#: Sources up to which their table is broadcast; more meet the rows in a shuffle.
BROADCAST_SOURCES = 50_000
SEED = 11


def size_of(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def sources_of(sizes: DataFrame) -> DataFrame:
    """source, source_size, n_docs, ix (from 0 in order of code points, null last) of sizes(source, size), one row per source."""
    spark = sizes.sparkSession
    found = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "sources")
    order = [F.col("source").isNull(), F.col("source")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # numbered in ranges, each behind the rows of the ranges before it
    dealt = materialize(found.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "source-ranges")
    counts = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())  # one row per range
    bases = spark.createDataFrame([(p, sum(n for _, n in counts[:k])) for k, (p, _) in enumerate(counts)], "part int, base long")
    within = F.expr("row_number() OVER (PARTITION BY part ORDER BY source IS NULL, source) - 1")
    return dealt.join(F.broadcast(bases), "part").select("source", "source_size", "n_docs", (F.col("base") + within).alias("ix"))


def water_fill(sources: DataFrame, budget: int, epochs: int = EPOCHS) -> DataFrame:
    """sources(source_size, weight, ...) with target: the budget shared by weight (positive whole numbers), none above epochs * source_size."""
    exact = lambda number: F.lit(number).cast("decimal(19,0)")
    size, weight, cap = F.col("source_size").cast("decimal(19,0)"), F.col("weight").cast("decimal(16,0)"), F.col("source_size") * epochs
    total = int(sources.agg(F.sum("weight")).first()[0] or 0)
    left, shares = budget, total
    while True:
        over = size * exact(epochs * shares) < weight * exact(left)
        row = sources.where(over).agg(F.sum(cap), F.sum("weight")).first()
        rest = budget - int(row[0] or 0), total - int(row[1] or 0)  # without all that are clamped, earlier ones included
        if rest == (left, shares) or not rest[1]:
            break
        left, shares = rest
    if not rest[1]:
        return sources.withColumn("target", cap.cast("double"))
    part = (weight * exact(left)).cast("double") / F.lit(float(shares))
    return sources.withColumn("target", F.when(over, cap.cast("double")).otherwise(part))


def cyclic_weights(ix: Column, weights: tuple[int, ...] = (1, 2, 3)) -> Column:
    """The weight of each source by its number, the weights repeating."""
    return F.element_at(F.array(*[F.lit(w) for w in weights]), (ix % len(weights) + 1).cast("int")).cast("long")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, size, share, threshold, ...) sorted by group, falling size and seeded hash: which ones get one repetition more."""
    group, owed = None, 0.0
    for batch in batches:
        extra = np.zeros(batch.num_rows, bool)
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("group", "size", "share", "threshold")]
        for i, (g, size, share, threshold) in enumerate(zip(*columns)):
            if g != group:
                group, owed = g, 0.0
            owed += share * size
            if size and owed > threshold * size:
                extra[i] = True
                owed -= size
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(extra)], names=[*batch.schema.names, "extra"])


def repetitions(rows: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """rows(doc_id, source, size, ...) with source_size, target and repetitions by sources(source, source_size, n_docs, target)."""
    spark, columns = rows.sparkSession, rows.columns
    few = F.broadcast(sources) if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else sources
    named = few.select(F.col("source").alias("_s"), "source_size", "n_docs", "target")
    # nulls are equal to nulls, as a pair of keys that a shuffle can use too
    same = (F.coalesce("source", F.lit("")) == F.coalesce("_s", F.lit(""))) & (F.col("source").isNull() == F.col("_s").isNull())
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    number = lambda at: F.conv(F.substring("digest", at, 8), 16, 10).cast("long")
    dealt = rows.withColumn("digest", digest).join(named, same).drop("_s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = dealt.withColumns({"whole": F.floor(ratio).cast("int"), "share": ratio - F.floor(ratio), "threshold": number(25) / F.lit(float(2**32))})
    bucket = number(1) % F.greatest(F.lit(1), F.ceil(F.col("n_docs") / GROUP))
    dealt = dealt.withColumn("group", F.xxhash64("source", F.col("source").isNull(), bucket)).drop("n_docs")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    settled = dealt.where("share > 0").repartition(parts, "group").sortWithinPartitions("group", F.desc("size"), "digest")
    settled = settled.mapInArrow(_settle, StructType([*settled.schema.fields, StructField("extra", BooleanType())]))
    out = dealt.where("share = 0").withColumn("extra", F.lit(False)).unionByName(settled)
    return out.select(*columns, "source_size", "target", (F.col("whole") + F.col("extra").cast("int")).alias("repetitions"))


def measured(docs: DataFrame, *columns: Column) -> DataFrame:
    """doc_id, source, size of docs, and further columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), *columns)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, n_docs, ix, weight, target: the plan for a mix of `share` of all words of sizes(source, size)."""
    weighted = materialize(sources_of(sizes).withColumn("weight", cyclic_weights(F.col("ix"), weights)), "weights")
    total = int(weighted.agg(F.sum("source_size")).first()[0] or 0)
    return water_fill(weighted, int(total * share), epochs)


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, repetitions: how often the mix takes each document; texts are read once."""
    sizes = materialize(measured(docs), "sizes")
    return repetitions(sizes, targets(sizes, weights, share, epochs), seed)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, all columns untouched."""
    found = targets(materialize(measured(docs), "sizes"), weights, share, epochs)
    taken = repetitions(measured(docs, F.struct(*docs.columns).alias("_row")), found, seed).where("repetitions > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("repetitions")))).select("_row.*")
