"""Merging recall lists, reciprocal-rank fusion, reranking, labels and confidence."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.scores import clip, label
from ..functions.text import UNKNOWN_FILE, overlap, page_reference

#: Why an answer is not of high confidence.
NOTHING_FOUND = "未检索到任何相关片段"
SOME_SUPPORT = "证据具备一定相关性，但强支撑不足"
WEAK_SUPPORT = "证据相关性偏弱"


def merge_expansions(hits: DataFrame, score: str, k: int) -> DataFrame:
    """query_id, id, score, matched_queries, rank: one row per candidate from hits(query_id, ix, id, score, query).

    Expansions are folded in order: a strictly better one replaces the row and its matched
    queries, any other adds its query.
    """
    hit = F.struct(F.col("ix"), F.col(score).alias("score"), F.col("query"))
    start = F.struct(F.lit(None).cast("double").alias("score"), F.array().cast("array<string>").alias("matched"))

    def step(state: Column, x: Column) -> Column:
        better = state["score"].isNull() | (x["score"] > state["score"])
        return F.struct(
            F.when(better, x["score"]).otherwise(state["score"]).alias("score"),
            F.when(better, F.array(x["query"])).otherwise(F.array_union(state["matched"], F.array(x["query"]))).alias("matched"),
        )

    folded = hits.groupBy("query_id", "id").agg(F.aggregate(F.array_sort(F.collect_list(hit)), start, step).alias("m"))  # one element per expansion
    rows = folded.select("query_id", "id", F.col("m.score").alias(score), F.col("m.matched").alias("matched_queries"))
    best = Window.partitionBy("query_id").orderBy(F.desc(score), "id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def fuse(vector: DataFrame, keyword: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Reciprocal-rank fusion of two merged lists; the vector side's matched queries come first."""
    v = vector.select("query_id", "id", "vector_score", F.col("matched_queries").alias("vm"), F.col("rank").alias("vr"))
    w = keyword.select("query_id", "id", "keyword_score", F.col("matched_queries").alias("km"), F.col("rank").alias("kr"))
    both = v.join(w, ["query_id", "id"], "full_outer")
    part = lambda r: F.coalesce(1.0 / (settings.rrf_k + F.col(r)), F.lit(0.0))
    none = F.array().cast("array<string>")
    rows = both.select(
        "query_id",
        "id",
        F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"),
        F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"),
        (part("vr") + part("kr")).alias("fused_score"),
        F.array_union(F.coalesce("vm", none), F.coalesce("km", none)).alias("matched_queries"),
        F.coalesce("vr", F.lit(1 << 20) + F.col("kr")).alias("arrival"),
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "arrival")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= settings.candidate_k).drop("arrival")


def rerank(candidates: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """candidates(query_id, id, three scores, rank, keywords, content, metadata_text) with rerank_score, position and label."""
    top = F.max("fused_score").over(Window.partitionBy("query_id"))
    a, b, c, d, e = settings.weights
    fused = F.least(F.lit(1.0), F.col("fused_score") / F.when(top == 0, 1.0).otherwise(top))
    raw = a * fused + b * clip(F.col("vector_score")) + c * clip(F.col("keyword_score")) + d * overlap(F.col("keywords"), F.col("content")) + e * overlap(F.col("keywords"), F.col("metadata_text"))
    out = candidates.withColumn("raw_rerank_score", raw).withColumn("rerank_score", F.round(clip(F.col("raw_rerank_score")), 9)).withColumn("rerank_source", F.lit("local"))
    best = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    out = out.withColumn("position", F.row_number().over(best))
    return out.withColumn("document_confidence", label(F.col("rerank_score"), settings.document_high, settings.document_low))


def rerank_external(candidates: DataFrame, response: DataFrame, source: str = "online") -> DataFrame:
    """candidates(query_id, id, rank) with the scores of response(query_id, index from 0, relevance_score), named by their source.

    Indices without a candidate are ignored, candidates without a score get 0; of several scores for one index the largest counts.
    """
    scores = response.groupBy(F.col("query_id"), (F.col("index") + 1).alias("rank")).agg(F.max("relevance_score").alias("raw_rerank_score"))
    joined = candidates.join(scores, ["query_id", "rank"], "left")
    out = joined.withColumn("raw_rerank_score", F.coalesce("raw_rerank_score", F.lit(0.0))).withColumn("rerank_score", clip(F.col("raw_rerank_score"))).withColumn("rerank_source", F.lit(source))
    return out.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")))


def use_online(enabled: bool, provider: str, key: str | None, known: str = "cohere") -> bool:
    """Is the online reranker to be asked?"""
    return enabled and provider.strip().lower() == known and bool(key)


def rerank_with(candidates: DataFrame, reranker, source: str = "online", settings: Settings = DEFAULTS) -> DataFrame:
    """candidates(query_id, id, rank, query, content, and what `rerank` needs) scored by reranker(query, texts) -> scores, a
    query at a time; a query on which it fails is reranked locally. A query has candidate_k candidates at most."""
    rows = candidates.select("query_id", "rank", "query", "content")

    def score(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        texts = group.column("content").to_pylist()
        try:
            scores = [float(x) for x in reranker(group.column("query")[0].as_py(), texts)]
            good = len(scores) == len(texts)
        except Exception:  # foreign code: any failure means the local order
            good = False
        ranks = group.column("rank").to_pylist() if good else []
        return pa.table({"query_id": pa.array(group.column("query_id").to_pylist()[: len(ranks)], pa.int64()), "rank": pa.array(ranks, pa.int32()), "_score": pa.array(scores if good else [], pa.float64())})

    scored = rows.groupBy("query_id").applyInArrow(score, "query_id long, rank int, _score double")
    local = rerank(candidates, settings)
    joined = local.join(scored, ["query_id", "rank"], "left")
    done = F.col("_score").isNotNull()
    out = joined.withColumns({"raw_rerank_score": F.coalesce("_score", "raw_rerank_score"), "rerank_score": F.when(done, clip(F.col("_score"))).otherwise(F.col("rerank_score")), "rerank_source": F.when(done, source).otherwise(F.col("rerank_source"))})
    out = out.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank"))).drop("_score")
    return out.withColumn("document_confidence", label(F.col("rerank_score"), settings.document_high, settings.document_low))


def confidence(queries: DataFrame, ranked: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per query of queries(query_id): top1, top2, avg_top3, support, strong_support, confidence, reason."""
    top = ranked.where("position <= 3").groupBy("query_id").agg(
        F.count("*").alias("found"),
        F.max(F.when(F.col("position") == 1, F.col("rerank_score"))).alias("top1"),
        F.coalesce(F.max(F.when(F.col("position") == 2, F.col("rerank_score"))), F.lit(0.0)).alias("top2"),
        F.avg("rerank_score").alias("avg_top3"),
        F.count_if(F.col("rerank_score") >= settings.document_low).alias("support"),
        F.count_if(F.col("rerank_score") >= settings.document_high).alias("strong_support"),
    )
    out = queries.select("query_id").join(top, "query_id", "left").na.fill(0, ["top1", "top2", "avg_top3", "support", "strong_support"])
    level = (
        F.when((F.col("top1") >= settings.overall_high) & (F.col("support") >= 2) & (F.col("avg_top3") >= settings.average_gate), "high")
        .when((F.col("top1") >= settings.overall_low) & (F.col("support") >= 1), "medium")
        .otherwise("low")
    )
    part = lambda name, column: F.concat(F.lit(f"{name}="), F.format_string("%.3f", column))
    support = F.concat(F.lit("support="), F.col("support").cast("string"))
    reason = (
        F.when(F.col("found").isNull(), NOTHING_FOUND)
        .when(F.col("confidence") == "high", "")
        .when(F.col("confidence") == "medium", F.concat(F.lit(f"{SOME_SUPPORT}: "), F.concat_ws(", ", part("top1", F.col("top1")), support, part("avg_top3", F.col("avg_top3")))))
        .otherwise(F.concat(F.lit(f"{WEAK_SUPPORT}: "), F.concat_ws(", ", part("top1", F.col("top1")), part("top2", F.col("top2")), support, part("avg_top3", F.col("avg_top3")))))
    )
    return out.withColumn("confidence", level).withColumn("reason", reason).drop("found")


def reference(candidate) -> Column:
    """The public part of a candidate: candidate(name) gives its columns."""
    return F.struct(
        F.coalesce(candidate("file_name"), F.lit(UNKNOWN_FILE)).alias("file_name"),
        candidate("page_number").alias("page_number"),
        candidate("section_path").alias("section_path"),
        F.round(candidate("rerank_score"), 4).alias("score"),
        F.round(candidate("raw_rerank_score"), 4).alias("raw_score"),
        candidate("document_confidence").alias("confidence"),
        candidate("rerank_source").alias("rerank_source"),
    )


def candidate_debug(candidate) -> Column:
    """All scores of a candidate, to four decimals."""
    scores_ = {"vectorScore": "vector_score", "keywordScore": "keyword_score", "fusedScore": "fused_score", "rawRerankScore": "raw_rerank_score", "rerankScore": "rerank_score"}
    return F.struct(
        candidate("id").cast("string").alias("id"),
        F.coalesce(candidate("file_name"), F.lit(UNKNOWN_FILE)).alias("fileName"),
        candidate("page_number").alias("pageNumber"),
        candidate("section_path").alias("sectionPath"),
        *(F.round(candidate(c), 4).alias(n) for n, c in scores_.items()),
        candidate("document_confidence").alias("documentConfidence"),
        candidate("rerank_source").alias("rerankSource"),
        candidate("matched_queries").alias("matchedQueries"),
    )


def with_metadata(ranked: DataFrame) -> DataFrame:
    """ranked with file_name, page_number, section_path and rerank_source where it has none of them."""
    kinds = {"file_name": "string", "page_number": "int", "section_path": "string"}
    missing = {c: F.lit(None).cast(kinds[c]) for c in kinds if c not in ranked.columns}
    return ranked.withColumns(missing | ({} if "rerank_source" in ranked.columns else {"rerank_source": F.lit("local")}))


def documents(ranked: DataFrame) -> DataFrame:
    """query_id, position, content, metadata: candidates as documents whose metadata (strings) hold their scores."""
    names = ("vector_score", "keyword_score", "fused_score", "raw_rerank_score", "rerank_score", "rerank_source", "document_confidence")
    rows = with_metadata(ranked)
    own = [x for n in ("file_name", "page_number", "section_path", *names) for x in (F.lit(n), F.col(n).cast("string"))]
    return rows.select("query_id", "position", "content", F.map_filter(F.create_map(*own), lambda _, v: v.isNotNull()).alias("metadata"))


#: Labels of an evidence block and of what the answering tool says.
EVIDENCE = ("【证据 ", "】")
SOURCE, DOCUMENT_LEVEL, RERANKED_BY, RERANK_SCORE = "来源: ", "文档置信度: ", "重排来源: ", "重排分数: "
OVERALL_LEVEL, LEVEL_REASON, LEVEL_STATISTICS = "检索整体置信度: ", "置信度说明: ", "置信度统计: "
NO_EVIDENCE, NO_ANSWER = "当前没有命中知识库证据。", "没有找到相关信息。"


def tool_text(explained: DataFrame) -> DataFrame:
    """explained (of `explain`) with what the answering tool says: the level with its reason and statistics, then the evidence."""
    debug = lambda name: F.get_json_object("confidence_debug", f"$.{name}")
    pairs = (("top1", "top1Score"), ("top2", "top2Score"), ("avgTop3", "avgTop3Score"), ("support", "supportCount"))
    statistics = F.concat_ws(", ", *(F.concat(F.lit(f"{label_}="), debug(name)) for label_, name in pairs))
    lines = [
        F.concat(F.lit(OVERALL_LEVEL), F.col("confidence")),
        F.concat(F.lit(RERANKED_BY), debug("provider")),
        F.when(F.col("reason") != "", F.concat(F.lit(LEVEL_REASON), F.col("reason"))),
        F.concat(F.lit(LEVEL_STATISTICS), statistics),
    ]
    body = F.when(F.col("context_text") == "", NO_EVIDENCE).otherwise(F.col("context_text"))
    text = F.when(F.size("references") == 0, NO_ANSWER).otherwise(F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), body))
    return explained.withColumn("tool_text", text)


def explain(levels: DataFrame, ranked: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """levels (of `confidence`) with references of the final candidates, their context text, the numbered reference list
    and a debug object in JSON. A query has final_k candidates at most, so its rows are gathered."""
    c = lambda row: lambda name: row[name]
    rows = with_metadata(ranked.where(F.col("position") <= settings.final_k))
    names = ["id", "content", "file_name", "page_number", "section_path", "vector_score", "keyword_score", "fused_score", "raw_rerank_score", "rerank_score", "rerank_source", "document_confidence", "matched_queries"]
    nested = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", *names))).alias("_rows"))
    out = levels.join(nested, "query_id", "left").withColumn("_rows", F.coalesce("_rows", F.filter(F.array(F.lit(None).cast(nested.schema["_rows"].dataType.elementType)), lambda x: x.isNotNull())))

    def evidence(x: Column, i: Column) -> Column:
        parts = [
            F.concat(F.lit(EVIDENCE[0]), (i + 1).cast("string"), F.lit(EVIDENCE[1])),
            F.concat(F.lit(SOURCE), page_reference(x["file_name"], x["page_number"], x["section_path"])),
            F.concat(F.lit(DOCUMENT_LEVEL), x["document_confidence"]),
            F.concat(F.lit(RERANKED_BY), x["rerank_source"]),
            F.concat(F.lit(RERANK_SCORE), F.format_string("%.3f", x["rerank_score"]), F.lit(" (raw="), F.format_string("%.3f", x["raw_rerank_score"]), F.lit(")")),
            F.coalesce(x["content"], F.lit("")),
        ]
        return F.concat_ws("\n", *parts)

    def line(x: Column, i: Column) -> Column:
        number = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x["score"]), "0+$", ""), r"\.$", ".0")
        suffix = F.concat(F.lit(" (score="), number, F.lit(", confidence="), x["confidence"], F.lit(")"))
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), page_reference(x["file_name"], x["page_number"], x["section_path"]), suffix)

    provider = F.coalesce(F.get("_rows", F.lit(0))["rerank_source"], F.lit("local"))
    limits = F.struct(*(F.lit(v).alias(n) for n, v in (("overallHigh", settings.overall_high), ("overallLow", settings.overall_low), ("documentHigh", settings.document_high), ("documentLow", settings.document_low))))
    debug = F.struct(
        provider.alias("provider"),
        F.col("reason"),
        F.round("top1", 4).alias("top1Score"),
        F.round("top2", 4).alias("top2Score"),
        F.round("avg_top3", 4).alias("avgTop3Score"),
        F.col("support").alias("supportCount"),
        F.col("strong_support").alias("strongSupportCount"),
        F.when(F.size("_rows") > 0, limits).alias("thresholds"),
        F.transform(F.slice("_rows", 1, 5), lambda x: candidate_debug(c(x))).alias("candidates"),
    )
    out = out.withColumn("references", F.transform("_rows", lambda x: reference(c(x))))
    out = out.withColumn("context_text", F.array_join(F.transform("_rows", evidence), "\n\n")).withColumn("reference_list", F.array_join(F.transform("references", line), "\n"))
    return out.withColumn("confidence_debug", F.to_json(debug)).drop("_rows")
