"""Tables of Parquet or JSON folders: whole versions behind a pointer, and buckets of keys that change in place."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.governance import upsert
from ..session import settle


def _fs(spark: SparkSession, path: str):
    """(file system, path) of a path in whatever store it is."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    fs, own = _fs(spark, path)
    return fs.exists(own)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    fs, own = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(own)) if fs.exists(own) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, own = _fs(spark, path)
    fs.delete(own, True)


def claim(spark: SparkSession, path: str, text: str = "") -> bool:
    """Put a small file with text in place, whole or not at all; False where another writer was first. Rests on the store's rename
    not replacing files, as in HDFS."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, target = _fs(spark, path)
    fs.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(target), none)
    except Py4JJavaError:
        if not fs.exists(target):
            raise
        fs.delete(draft, False)
        return False
    return True


def told(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, own = _fs(spark, path)
    stream = fs.open(own)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(df: DataFrame, root: str, form: str = "parquet") -> str:
    """Write the next version of a table and point to it by a file put in place last; readers see whole versions. Of two
    writers of one version the later fails, as the version's folder or pointer exists."""
    spark = df.sparkSession
    version = current_version(spark, root) + 1
    path = f"{root}/v{version:08d}"
    df.write.mode("errorifexists").format(form).save(path)
    if not claim(spark, f"{root}/_pointer/{version:08d}"):
        raise FileExistsError(f"version {version} of {root} exists")
    return path


def current_version(spark: SparkSession, root: str) -> int:
    """0 where nothing was published."""
    return max((int(n) for n in children(spark, f"{root}/_pointer") if n.isdigit()), default=0)


def version_path(spark: SparkSession, root: str, version: int | None = None) -> str:
    return f"{root}/v{version or current_version(spark, root):08d}"


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(version_path(spark, root, version))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def rebuild(spark: SparkSession, root: str, fresh: DataFrame, backup: str) -> DataFrame:
    """Copy a table to a backup, refusing to overwrite one, and publish fresh as its next version: one summary row. Readers of the
    table meet the old version or the new one at any time."""
    if exists(spark, backup):
        raise ValueError(f"{backup} exists")
    kept = current_version(spark, root) > 0
    if kept:
        publish(read(spark, root), backup)
    publish(fresh, root)
    return read(spark, root).agg(F.count("*").alias("n_rows")).select(F.lit(root).alias("table"), F.when(F.lit(kept), backup).alias("backup"), "n_rows")


@dataclass(frozen=True)
class Buckets:
    """A table in n partitions by a hash of its key. An upsert reads and writes only the buckets its rows fall in; others are not
    touched. Repeating an upsert changes nothing. Buckets are put in place one by one as the write commits, so a reader at that
    moment may meet some old and some new ones, and one that listed files before may have to list them again."""

    root: str
    key: tuple[str, ...]
    n: int = 256

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.n)).cast("int")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.root).drop("bucket")

    def write(self, df: DataFrame) -> None:
        """Put the buckets that df has in place of those there are."""
        spread = df.withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        spread.write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.root)

    def merged(self, new: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """The rows of the buckets that new falls in after its upsert; new is read twice and should be a table."""
        spark = new.sparkSession
        if not exists(spark, self.root):
            return new
        met = sorted(r[0] for r in new.select(self.bucket()).distinct().collect())  # at most n numbers
        return upsert(spark.read.parquet(self.root).where(F.col("bucket").isin(met)).drop("bucket"), new, list(self.key), keep)

    def upsert(self, new: DataFrame, keep: tuple[str, ...] = ()) -> None:
        """Insert the rows of new or, on equal key, replace all but the columns in keep; keys of new are distinct."""
        self.write(self.merged(settle(new, "upsert"), keep))
