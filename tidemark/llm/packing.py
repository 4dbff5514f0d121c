"""Best-fit packing planned on the histogram of lengths.

Documents are tokenised and cut into pieces once, kept as small rows of lengths.
The number of pieces of each length, at most `capacity` numbers whatever the input,
is all that the planner sees: best-fit decreasing moves whole runs of equal
sequences at a time. It yields slots, intervals of ranks within a length that take
consecutive sequences at one offset. Pieces then take their slots by their rank
within their length, computed from counts per salted bucket, so that a length which
holds most pieces is still spread over many tasks.

Null texts count as empty: one piece, the separator. Texts are encoded whole; longer
ones than `capacity` are cut into full pieces with the remainder first. Rows with
repeated or null ids are packed each. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, materialize, whole_texts
from .token_bytes import token_bytes

CAPACITY = 1024
#: Rows in a bucket of one length, about; ranks are numbered bucket by bucket.
BUCKET = 1_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only longer ones are cut, the remainder first."""
    first = n if n <= capacity else n % capacity
    out = [(0, first)] if first else []
    return out + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str, separator: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every text."""

    def make():
        encode, end = token_bytes(vocabulary, "<u4"), np.array([separator], "<u4").tobytes()

        def run(batch):
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text) + end
                out += [(doc_id, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            return list(zip(*out))

        return run

    return map_texts(whole_texts(docs), make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset) of each slot interval; ranks of a length are gapless.

    Best-fit decreasing: a piece goes where the least room remains that holds it. All
    sequences with equal room form runs, so a step places many pieces of one length.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs (first sequence, how many)
    rooms: list[int] = []  # sorted keys of room
    slots: list[tuple[int, int, int, int]] = []
    fresh = 0

    def put(left: int, first: int, many: int) -> None:
        if left and many:
            if not room[left]:
                bisect.insort(rooms, left)
            room[left].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, many = room[left].pop()
                if not room[left]:
                    rooms.pop(at)
            else:
                left, first, many = capacity, fresh, -(-todo // (capacity // length))
                fresh += many
            each = left // length
            full = min(many, todo // each)
            for j in range(each):
                if full:
                    slots.append((length, rank, first, capacity - left + j * length))
                    rank += full
            todo -= full * each
            put(left - each * length, first, full)
            first, many = first + full, many - full
            if many and todo and todo < each:  # the last pieces share one sequence
                for j in range(todo):
                    slots.append((length, rank, first, capacity - left + j * length))
                    rank += 1
                put(left - todo * length, first, 1)
                first, many, todo = first + 1, many - 1, 0
            put(left, first, many)
    return slots


def ranked(cuts: DataFrame, counts: dict[int, int]) -> DataFrame:
    """cuts, a table of Parquet files, with rank: gapless from 0 within each length. A length has as many buckets as its
    count needs; rows are salted by their place in the files, so that repeated rows spread as well."""
    # one row per length, capacity rows at most
    buckets = cuts.sparkSession.createDataFrame([(n, 1 + many // BUCKET) for n, many in counts.items()], "length long, buckets long")
    placed = cuts.withColumn("salt", F.xxhash64("_metadata.file_name", "_metadata.row_index"))
    salted = placed.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod("salt", "buckets")).drop("buckets")
    sizes = salted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    bases = sizes.select("length", "bucket", before.alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "salt"))
    return salted.withColumn("own", own).join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("own") - 1).drop("bucket", "base", "own", "salt")


def pack(docs: DataFrame, vocabulary: str, separator: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cuts = materialize(pieces(docs, vocabulary, separator, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots = sorted(plan(counts, capacity))
    # at most one interval per length and run; runs number capacity squared at most
    starts = spark.sparkContext.broadcast(np.array([length << 40 | rank for length, rank, _, _ in slots], np.int64))
    targets = spark.sparkContext.broadcast(np.array([(rank, first, offset) for _, rank, first, offset in slots], np.int64).reshape(-1, 3))

    def take(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            rows = targets.value[np.searchsorted(starts.value, length << 40 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows[:, 1] + rank - rows[:, 0]), pa.array(rows[:, 2])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    rows = ranked(cuts, counts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInArrow(take, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
