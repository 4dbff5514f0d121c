"""Low-confidence events, curation of chunks and their history, as table transforms.

Tables are immutable: a write is a function from the old table and the change to the
new one, published by `sources.tables.publish`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS


def score4(c: Column) -> Column:
    return c.cast("decimal(8,4)")


def low_confidence_events(confidence: DataFrame, understood: DataFrame, created_at: Column) -> DataFrame:
    """Events of the queries whose answer was of low confidence; scores as decimal(8,4)."""
    rows = confidence.where("confidence = 'low'").join(understood, "query_id")
    return rows.select(
        F.col("query_id").alias("event_id"),
        F.col("query").alias("raw_query"),
        "normalized_query",
        "query_fingerprint",
        F.col("confidence").alias("overall_confidence"),
        score4(F.col("top1")).alias("top1_score"),
        score4(F.col("top2")).alias("top2_score"),
        score4(F.col("avg_top3")).alias("avg_top3_score"),
        created_at.alias("created_at"),
    )


def event_snapshots(events: DataFrame, ranked: DataFrame, chunks: DataFrame, k: int = DEFAULTS.snapshot_k) -> DataFrame:
    """The first k candidates of each event with their chunk's id, null where the chunk is gone."""
    top = ranked.where(F.col("position") <= k).join(events.select(F.col("event_id").alias("query_id")), "query_id")
    known = chunks.select(F.col("chunk_key"), F.col("id").alias("chunk_id"))
    keyed = top.withColumn("chunk_key", F.col("id").cast("string"))
    return keyed.join(known, "chunk_key", "left").select(
        F.col("query_id").alias("event_id"),
        "chunk_id",
        F.col("chunk_key").alias("chunk_key_snapshot"),
        F.col("position").alias("rank_no"),
        score4(F.col("vector_score")).alias("vector_score"),
        score4(F.col("keyword_score")).alias("keyword_score"),
        score4(F.col("fused_score")).alias("fused_score"),
        score4(F.col("rerank_score")).alias("rerank_score"),
        "document_confidence",
        "matched_queries",
    )


def fingerprint_groups(events: DataFrame, limit: int | None = 50) -> DataFrame:
    """Groups of events by fingerprint, largest and latest first; limit None gives all."""
    groups = events.groupBy("query_fingerprint").agg(
        F.min("normalized_query").alias("normalized_query"), F.count("*").alias("event_count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen")
    )
    return groups if limit is None else groups.orderBy(F.desc("event_count"), F.desc("last_seen"), "query_fingerprint").limit(limit)


def fingerprint_detail(events: DataFrame, snapshots: DataFrame, fingerprint: str | None = None, limit: int | None = 50) -> DataFrame:
    """Events, newest first, each with its candidates nested in rank order."""
    own = events if fingerprint is None else events.where(F.col("query_fingerprint") == fingerprint)
    if limit is not None:
        own = own.orderBy(F.desc("created_at"), F.desc("event_id")).limit(limit)
    nested = snapshots.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("rank_no", "chunk_key_snapshot", "document_confidence"))).alias("chunks"))  # k per event
    return own.join(nested, "event_id", "left")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new inserted or, on equal key, replaced but for the columns in keep."""
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full_outer")
    hit = F.col("n._new").isNotNull()

    def pick(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}")
        if c in keep:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        return F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*[pick(c).alias(c) for c in old.columns])


def upsert_documents(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Documents by (collection_name, source_path): ids and created_at of known ones stay, updated_at is now for all that are written."""
    return upsert(old, new.withColumn("updated_at", now), ["collection_name", "source_path"], keep=("id", "created_at"))


def merge_metadata(old: Column, new: Column) -> Column:
    """Union of two maps; the new map's values win."""
    new = F.coalesce(new, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(new, k)), new)


def replace_source(old: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """old without the rows of the sources that new has, plus new; rows without a source stay."""
    gone = new.select(F.col(source).alias("_gone")).distinct()
    return old.join(gone, F.col(source) == F.col("_gone"), "left_anti").unionByName(new)


def save_drafts(chunks: DataFrame, drafts: DataFrame) -> DataFrame:
    """Set draft_text from drafts(chunk_key, draft); blank drafts are refused."""
    good = drafts.where(F.length(F.trim("draft")) > 0).groupBy("chunk_key").agg(F.max("draft").alias("draft"))
    joined = chunks.join(good, "chunk_key", "left")
    return joined.withColumn("draft_text", F.coalesce("draft", "draft_text")).withColumn("sync_status", F.when(F.col("draft").isNotNull(), "draft").otherwise(F.col("sync_status"))).select(*chunks.columns)


def publish(chunks: DataFrame, edits: DataFrame, created_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, new history rows) after publishing edits(chunk_key, editor, edit_note) at created_at, by default now.

    A chunk with a draft gets it as published text, the next version and status synced;
    without one it is marked publish_failed and gets no history row. Of several edits of a
    chunk the one with the largest (editor, edit_note) counts, nulls least.
    """
    asked = edits.groupBy("chunk_key").agg(F.max(F.struct("editor", "edit_note")).alias("e")).select("chunk_key", "e.editor", "e.edit_note")
    joined = chunks.join(asked.withColumn("_asked", F.lit(True)), "chunk_key", "left")
    has = F.length(F.trim(F.coalesce("draft_text", F.lit("")))) > 0
    go, fail = F.col("_asked").isNotNull() & has, F.col("_asked").isNotNull() & ~has
    history = joined.where(go).select(
        F.col("id").alias("chunk_id"), (F.col("published_version") + 1).alias("version_no"), F.col("published_text").alias("old_text"), F.col("draft_text").alias("new_text"), "editor", "edit_note", F.lit("published").alias("publish_status"), (F.current_timestamp() if created_at is None else created_at).alias("created_at")
    )
    changes = {
        "published_text": F.when(go, F.col("draft_text")).otherwise(F.col("published_text")),
        "published_version": F.when(go, F.col("published_version") + 1).otherwise(F.col("published_version")),
        "draft_text": F.when(~go | go.isNull(), F.col("draft_text")),
        "sync_status": F.when(go, "synced").when(fail, "publish_failed").otherwise(F.col("sync_status")),
        "last_publish_error": F.when(fail, "empty draft").when(~go | go.isNull(), F.col("last_publish_error")),
    }
    return joined.select(*[changes.get(c, F.col(c)).alias(c) for c in chunks.columns]), history


def list_history(history: DataFrame, chunk_id: int | None = None) -> DataFrame:
    """The latest versions first, of one version the latest created."""
    own = history if chunk_id is None else history.where(F.col("chunk_id") == chunk_id)
    return own.orderBy(F.desc("version_no"), F.desc("created_at"), "chunk_id")


def enrich(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents.select(F.col("id").alias("document_id"), "collection_name", "source_path", "file_name", "file_ext"), "document_id", "left")


def chunk_by_key(chunks: DataFrame, chunk_key: str) -> DataFrame:
    """The chunk, or no row."""
    return chunks.where(F.col("chunk_key") == chunk_key)


def chunk_by_id(chunks: DataFrame, chunk_id: int) -> DataFrame:
    return chunks.where(F.col("id") == chunk_id)


def document_by_source(documents: DataFrame, collection: str, source_path: str) -> DataFrame:
    return documents.where((F.col("collection_name") == collection) & (F.col("source_path") == source_path))


def chunks_of_document(chunks: DataFrame, document_id) -> DataFrame:
    """A document's chunks in their order."""
    return chunks.where(F.col("document_id") == F.lit(document_id)).orderBy("chunk_index", "id")


def history_of_key(history: DataFrame, chunks: DataFrame, chunk_key: str) -> DataFrame:
    """The edits of a chunk, newest first; a job over a key without a chunk fails."""
    missing = F.raise_error(F.lit(f"no chunk {chunk_key}"))
    own = chunk_by_key(chunks, chunk_key).agg(F.max("id").alias("chunk_id")).select(F.coalesce("chunk_id", missing).alias("chunk_id"))
    return list_history(history.join(F.broadcast(own), "chunk_id", "left_semi"))  # one row


def audit_versions(history: DataFrame) -> DataFrame:
    """Position of each edit of a chunk, oldest first."""
    return history.withColumn("edit_no", F.row_number().over(Window.partitionBy("chunk_id").orderBy("version_no", "created_at")))


def cascade(children: DataFrame, removed: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """children without those whose parent is in removed."""
    return children.join(removed.select(F.col(key).alias("_gone")), F.col(foreign) == F.col("_gone"), "left_anti")


def set_null(children: DataFrame, removed: DataFrame, foreign: str, key: str = "id") -> DataFrame:
    """children with the foreign key nulled where the parent is in removed."""
    gone = removed.select(F.col(key).alias("_gone")).distinct()
    joined = children.join(gone, F.col(foreign) == F.col("_gone"), "left")
    return joined.withColumn(foreign, F.when(F.col("_gone").isNull(), F.col(foreign))).drop("_gone")
