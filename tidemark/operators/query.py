"""Query understanding and fingerprints, as expressions over a query table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint, keywords, normalize_query, some, squash


def understand(queries: DataFrame) -> DataFrame:
    """queries(query_id, query[, summary][, recent array<struct<role,content>>]) with primary_query,
    keyword_query, expanded_queries (3 at most) and keywords (12 at most)."""
    has = set(queries.columns)
    summary: Column = F.coalesce("summary", F.lit("")) if "summary" in has else F.lit("")
    users = F.filter(F.slice("recent", F.greatest(F.size("recent") - 3, F.lit(1)), 4), lambda m: m["role"] == "user") if "recent" in has else None
    recent: Column = F.coalesce(F.array_join(F.transform(users, lambda m: m["content"]), " "), F.lit("")) if users is not None else F.lit("")
    base = queries.withColumn("primary_query", squash(F.coalesce("query", F.lit("")))).withColumn("_summary", summary).withColumn("_recent", recent)
    text = F.concat_ws(" ", some(F.col("_summary")), some(F.col("_recent")), some(F.col("primary_query")))
    base = base.withColumn("keywords", keywords(text))
    first = F.array_join(F.slice("keywords", 1, 8), " ")
    base = base.withColumn("keyword_query", F.coalesce(some(first), F.col("primary_query")))
    fresh = (F.col("_recent") != "") & (F.col("_recent") != F.col("primary_query")) & (F.col("_recent") != F.col("keyword_query"))
    with_summary = F.when(F.col("_summary") != "", F.concat(F.left("_summary", F.lit(120)), F.lit(" "), "primary_query"))
    fresh = fresh & ~F.col("_recent").eqNullSafe(with_summary)
    options = F.array(
        F.col("primary_query"),
        F.when(F.col("keyword_query") != F.col("primary_query"), F.col("keyword_query")),
        with_summary,
        F.when(fresh, F.concat(F.right("_recent", F.lit(120)), F.lit(" "), "primary_query")),
    )
    cleaned = F.filter(F.transform(F.array_compact(options), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return base.withColumn("expanded_queries", F.slice(F.array_distinct(cleaned), 1, 3)).drop("_summary", "_recent")


def expansions(understood: DataFrame) -> DataFrame:
    """query_id, ix (from 0), query: one row per expansion."""
    return understood.select("query_id", F.posexplode("expanded_queries").alias("ix", "query"))


def with_fingerprint(understood: DataFrame) -> DataFrame:
    out = understood.withColumn("normalized_query", normalize_query(F.coalesce(some(F.col("primary_query")), F.col("query"), F.lit(""))))
    return out.withColumn("query_fingerprint", fingerprint(F.col("normalized_query"), F.col("keyword_query"), F.col("keywords")))
