"""Exact duplicates with a heavy-hitter split.

A Misra-Gries summary of the digests finds every digest that may hold more than
1/counters of the rows. Its candidates are counted exactly; their winners, at most
`counters` rows whatever the input, are broadcast and settle their rows on the map
side. All other digests are aggregated and joined by an ordinary shuffle, in which
no key holds more than that share.

Null texts count as empty and equal to empty texts. Of equal texts the row with the
largest doc_id stays; null ids lose to any other. Rows that repeat the winner's
doc_id as well as its text all count as staying; keep_one keeps one of them. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole_texts, without

#: Counters of the Misra-Gries summary: bounds what is broadcast and the share of rows a shuffled key may hold.
COUNTERS = 256
#: Summaries merged by one task at each level of the merge tree.
FAN_IN = 32


def digest(text) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    return whole_texts(docs).select("doc_id", digest(F.col("text")).alias("digest"))


def _shrink(counts: Counter, counters: int) -> Counter:
    """Keep at most `counters` entries: subtract the largest count that has to go."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def _summarizer(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary: Counter = Counter()
        for batch in batches:
            if "n" in batch.schema.names:
                for k, v in zip(batch.column("digest").to_pylist(), batch.column("n").to_pylist()):
                    summary[k] += v
            else:
                summary.update(batch.column("digest").to_pylist())
            summary = _shrink(summary, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(summary), pa.binary()), pa.array(list(summary.values()), pa.int64())], names=["digest", "n"])

    return run


def heavy_candidates(keys: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digest, n (a lower bound): a Misra-Gries summary of keys.digest, merged in a tree."""
    summary = keys.select("digest").mapInArrow(_summarizer(counters), "digest binary, n long")
    parts = keys.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        summary = summary.repartition(parts).mapInArrow(_summarizer(counters), "digest binary, n long")
    return summary


def classes(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, digest, keep_id, group_size for every row."""
    keys = materialize(digests(docs), "digests")
    candidates = materialize(heavy_candidates(keys, counters).select("digest"), "heavy")
    # at most `counters` rows each: the bound of the summary
    totals = [F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    winners = materialize(keys.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(*totals), "winners")
    heavy = keys.join(F.broadcast(winners), "digest")
    light = keys.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = light.groupBy("digest").agg(*totals)
    return heavy.unionByName(light.join(groups, "digest"))


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return classes(docs, counters).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, all columns untouched; of rows that repeat id and text, one."""
    named = classes(docs, counters).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # a row of another id goes; one that stays is listed only where it is repeated
    keyed = named.groupBy("doc_id", "digest").agg(F.first("stays").alias("once"), F.count("*").alias("n")).where("NOT once OR n > 1")
    gone = materialize(keyed.select("doc_id", "digest", "once"), "dropped")
    return without(docs, [docs["doc_id"].cast("long"), digest(docs["text"])], gone)
