"""Helpers shared by the corpus operators: shared scratch tables, batch sizing, bounded caches."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows turned into Python objects at a time, and the bytes of an Arrow batch where the session does not ask for fewer.
ARROW_ROWS, ARROW_BYTES = 500, 2 << 20

_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


_caches: list = []


def per_worker(make: Callable) -> Callable:
    """Cache what make returns for the life of a Python worker, or until another operator releases it."""
    cached = functools.cache(make)
    _caches.append(cached)
    return cached


def release_caches() -> None:
    """Drop the vocabularies and memos that other operators left in this worker, which serves one query after another."""
    for cached in _caches:
        cached.cache_clear()


@functools.cache
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="scratch-")


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, which hold whole texts on both sides of a task; the rows of a batch, which short
    rows depend on, stay as the session has them. Plans read the setting when they run, so it stays for the session."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    asked = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, "64m"))
    if not 0 < asked <= ARROW_BYTES:
        spark.conf.set(name, f"{ARROW_BYTES}b")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset, a folder of this machine
    stands in for local sessions; on a cluster executors would not see it, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _local_root()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if (own := _tables.get()) is not None:
        own.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, in whatever store it is."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made within are removed at the end: what needs them must have been written by then."""
    own: list[str] = []
    token = _tables.set(own)
    try:
        yield
    finally:
        _tables.reset(token)
        for path in own:
            remove(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder, read back. Survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_texts(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text (null becomes empty) and the named columns, nothing else."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *columns)


def held_out(doc_id) -> F.Column:
    """The remainder rule that splits learning rows from held-out rows."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, list], list]], schema: str | StructType) -> DataFrame:
    """Run a batch function over (columns of df) -> (columns of schema), some rows of an Arrow batch at a time.

    make() runs once per task on the executor and returns the function, which gets
    the rows as a dict of Python lists and returns a list of columns.
    """
    bound_batches(df.sparkSession)
    arrow = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ARROW_ROWS):
                part = batch.slice(at, ARROW_ROWS)
                columns = f({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


#: Bits of the map-side filter of `without`: 4096 bitmaps of 4 KB whatever the input.
FILTER_BITS = 1 << 27


def unused(docs: DataFrame, name: str) -> str:
    """name, or one like it that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_row(docs: DataFrame) -> F.Column:
    """All columns of docs in one, so that a plan's own columns may have any name."""
    return F.struct(*(docs[f"`{c}`"] for c in docs.columns))


def without(docs: DataFrame, keys: list[F.Column], gone: DataFrame) -> DataFrame:
    """docs without the rows whose keys (expressions over docs) stand in gone(<keys>, once); where `once`
    is true, one row of each key stays, the first by its other columns.

    A bitmap of the hashes of gone's keys, 16 MB whatever the input, is broadcast and lets all
    other rows pass on the map side. Only the rows that it hits, those that go and few others,
    meet gone itself, so texts that stay are not shuffled. Nulls are equal to nulls. gone is read
    several times and should be a table. Columns of docs may have any name.
    """
    names = [c for c in gone.columns if c != "once"]
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    filled = gone.groupBy(F.bitmap_bucket_number(place(names)).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(names))).alias("_bits"))
    own = [f"_own{i}" for i in range(len(keys))]
    rows = docs.select(whole_row(docs).alias("_row"), *(k.alias(n) for k, n in zip(keys, own)))
    rows = rows.withColumn("_at", F.bitmap_bit_position(place(own))).join(F.broadcast(filled), F.bitmap_bucket_number(place(own)) == F.col("_bucket"), "left")
    bit = F.expr("coalesce(getbit(cast(conv(hex(substring(_bits, cast(_at div 8 as int) + 1, 1)), 16, 10) as int), cast(_at % 8 as int)), 0)")
    same = [F.col(n).eqNullSafe(F.col(f"_gone.{k}")) for n, k in zip(own, names)]
    hits = rows.where(bit == 1).drop("_at", "_bucket", "_bits")
    stay = rows.where(bit == 0).select("_row").unionByName(hits.join(gone.alias("_gone"), same, "left_anti").select("_row"))
    once = gone.where("once")
    if not once.isEmpty():
        firsts = hits.join(once.alias("_gone"), same, "left_semi").groupBy(*own).agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
        stay = stay.unionByName(firsts.select("_row"))
    return stay.select("_row.*")


class TwoAges(dict):
    """A bounded memo: misses are computed by `fill`; two generations of `limit` entries at most.

    Entries used while they are in the older generation move to the younger one,
    so frequent keys stay and the long tail goes.
    """

    def __init__(self, fill: Callable, limit: int = 250_000):
        super().__init__()
        self.fill, self.limit, self.old = fill, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.fill(key)
        self[key] = value
        return value
