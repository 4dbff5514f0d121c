"""Publishing edits of chunks with one outcome for every reader.

A log of edits lies beside the chunk table. An entry is a folder of rows, and it counts once a small file with its number and
its folder's name is put in place: this is the only commit. What readers see - the chunks' texts and states, the history, the
vectors and the postings - is derived from the table and the same entries, each chunk by its last edit, so it changes everywhere
at once or not at all. A writer whose number was taken by another reads the log again and works anew on what that one left:
a draft is published once.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import tokens
from ..operators import bm25, vector
from ..session import settle, small
from ..sources import tables

#: Rows of the log: a draft, or what became of publishing one.
ENTRY = "chunk_key string, action string, text string, version int, old_text string, editor string, edit_note string, error string, created_at timestamp, embedding array<double>"
#: Times that a writer starts anew after others were first.
ATTEMPTS = 20


def folders(spark: SparkSession, root: str) -> list[str]:
    """The folders of the entries that count, in order."""
    names = [n for n in tables.children(spark, f"{root}/_log") if n.isdigit()]
    return [f"{root}/entries/{tables.told(spark, f'{root}/_log/{n}')}" for n in names]


def log(spark: SparkSession, root: str, done: list[str] | None = None) -> DataFrame:
    """All rows of the log with the number of their entry."""
    done = folders(spark, root) if done is None else done
    if not done:
        return spark.createDataFrame([], f"{ENTRY}, number int")
    numbers = F.broadcast(spark.createDataFrame([(f.rpartition("/")[2], i) for i, f in enumerate(done)], "_name string, number int"))  # a row per entry
    rows = spark.read.schema(ENTRY).parquet(*done).withColumn("_name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return rows.join(numbers, "_name").drop("_name")


def _append(spark: SparkSession, root: str, make) -> DataFrame:
    """Append the rows that make(log) returns for the log as it is, anew where another writer was first."""
    for _ in range(ATTEMPTS):
        done = folders(spark, root)
        name = uuid.uuid4().hex
        make(log(spark, root, done)).write.parquet(f"{root}/entries/{name}")
        if commit(spark, root, len(done), name):
            return spark.read.schema(ENTRY).parquet(f"{root}/entries/{name}")
        tables.remove(spark, f"{root}/entries/{name}")
    raise RuntimeError(f"{root}: other writers were first {ATTEMPTS} times")


def commit(spark: SparkSession, root: str, number: int, name: str) -> bool:
    """Let an entry count as the one of this number; False if another one does."""
    return tables.claim(spark, f"{root}/_log/{number:08d}", name)


def _last(rows: DataFrame, *actions: str) -> DataFrame:
    """chunk_key and e: each chunk's last row of one of the actions."""
    return rows.where(F.col("action").isin(*actions)).groupBy("chunk_key").agg(F.max_by(F.struct(*rows.columns), "number").alias("e"))


def chunks(base: DataFrame, rows: DataFrame) -> DataFrame:
    """The chunks base(chunk_key, published_text, draft_text, published_version, sync_status, last_publish_error, ...) as the log's
    rows leave them."""
    text = _last(rows, "published").select("chunk_key", F.col("e").alias("_p"))
    draft = _last(rows, "published", "draft").select("chunk_key", F.col("e").alias("_d"))
    state = _last(rows, "published", "draft", "publish_failed").select("chunk_key", F.col("e").alias("_s"))
    edits = state.join(draft, "chunk_key", "left").join(text, "chunk_key", "left")
    joined = base.join(small(edits), "chunk_key", "left")
    changes = {
        "published_text": F.coalesce("_p.text", "published_text"),
        "published_version": F.coalesce("_p.version", "published_version"),
        "draft_text": F.when(F.col("_d").isNull(), F.col("draft_text")).when(F.col("_d.action") == "draft", F.col("_d.text")),
        "sync_status": F.when(F.col("_s").isNull(), F.col("sync_status")).when(F.col("_s.action") == "published", "synced").otherwise(F.col("_s.action")),
        "last_publish_error": F.when(F.col("_s").isNull() | (F.col("_s.action") == "draft"), F.col("last_publish_error")).otherwise(F.col("_s.error")),
    }
    return joined.select(*[changes.get(c, F.col(c)).alias(c) for c in base.columns])


def _row(rows: DataFrame, now, **values) -> DataFrame:
    """rows(chunk_key, ...) as rows of the log: named values, null for the rest."""
    kinds = [c.split(" ", 1) for c in ENTRY.split(", ")]
    own = {"chunk_key": F.col("chunk_key"), "created_at": now} | values
    return rows.select(*[own.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds])


def save_drafts(base: DataFrame, root: str, drafts: DataFrame) -> DataFrame:
    """Log drafts(chunk_key, draft) of known chunks; blank ones are refused."""
    good = drafts.where(F.length(F.trim("draft")) > 0).groupBy("chunk_key").agg(F.max(F.trim("draft")).alias("draft"))
    known = good.join(base.select("chunk_key"), "chunk_key", "left_semi")
    return _append(base.sparkSession, root, lambda rows: _row(known, F.current_timestamp(), action=F.lit("draft"), text=F.col("draft")))


def publish(base: DataFrame, root: str, edits: DataFrame, embedder=None, settings: Settings = DEFAULTS) -> DataFrame:
    """Publish the drafts of the chunks of edits(chunk_key, editor, edit_note): the rows of the log's new entry. A chunk without a draft is
    marked publish_failed. Of several edits of a chunk the one with the largest (editor, edit_note) counts, nulls least."""
    asked = small(edits.groupBy("chunk_key").agg(F.max(F.struct("editor", "edit_note")).alias("_e")))

    def make(rows: DataFrame) -> DataFrame:
        own = chunks(base, rows).join(asked, "chunk_key")
        has = F.length(F.trim(F.coalesce("draft_text", F.lit("")))) > 0
        now = F.current_timestamp()
        good = own.where(has)
        vectors = vector.embed(good, ["chunk_key"], "draft_text", settings.embedding_dim, embedder)
        done = good.join(vectors, "chunk_key")
        said = {"editor": F.col("_e.editor"), "edit_note": F.col("_e.edit_note")}
        published = _row(done, now, action=F.lit("published"), text=F.col("draft_text"), version=F.col("published_version") + 1, old_text=F.col("published_text"), embedding=F.col("embedding"), **said)
        failed = _row(own.where(~has), now, action=F.lit("publish_failed"), error=F.lit("empty draft"), **said)
        return published.unionByName(failed)

    return _append(base.sparkSession, root, make)


@dataclass
class View:
    """What readers see, all of it after the same entry."""

    chunks: DataFrame
    history: DataFrame
    vectors: DataFrame | None
    keywords: bm25.Index | None


def view(base: DataFrame, root: str, vectors: DataFrame | None = None, keywords: bm25.Index | None = None) -> View:
    """The chunks base(id, chunk_key, published_text, ...), their vectors(id, embedding) and the keyword index of their texts by id, as the
    log at root leaves them. The log is small beside these tables: what it changes is broadcast where few."""
    rows = log(base.sparkSession, root)
    done = rows.where("action = 'published'")
    named = done.join(base.select("chunk_key", F.col("id").alias("chunk_id")), "chunk_key")
    history = named.select("chunk_id", F.col("version").alias("version_no"), "old_text", F.col("text").alias("new_text"), "editor", "edit_note", F.lit("published").alias("publish_status"), "created_at")
    if vectors is None and keywords is None:
        return View(chunks(base, rows), history, None, None)
    edited = base.select("chunk_key", "id", F.col("published_text").alias("before")).join(small(_last(rows, "published")), "chunk_key").select("id", "before", F.col("e.text").alias("text"), F.col("e.embedding").alias("embedding"))
    edited = settle(edited, "edited")
    ids = small(edited.select("id"))
    if vectors is not None:
        vectors = vectors.join(ids, "id", "left_anti").select("id", "embedding").unionByName(edited.select("id", "embedding"))
    if keywords is not None:
        old, new = (bm25.postings(edited.select(F.col("id").alias("doc_id"), F.col(c).alias("text"))) for c in ("before", "text"))
        kept = keywords.postings.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti").select("token", "doc_id", "tf", "dl")
        changes = keywords.frequencies.select("token", "df").unionByName(new.select("token", F.lit(1).alias("df"))).unionByName(old.select("token", F.lit(-1).alias("df")))
        frequencies = changes.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
        length = lambda c: F.size(tokens(F.coalesce(F.col(c), F.lit(""))))
        more = edited.agg(F.sum(length("text") - length("before"))).first()[0] or 0
        n = keywords.n_docs
        keywords = bm25.Index(kept.unionByName(new.select(kept.columns)), frequencies, n, keywords.avg_len + more / n if n else 0.0)
    return View(chunks(base, rows), history, vectors, keywords)
