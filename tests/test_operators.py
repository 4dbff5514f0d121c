"""Hand-made cases for what the tables do not show: CJK text, quirks and golden numbers."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scores, text
from tidemark.operators import bm25, chunking, governance, memory, ops, query, ranking, vector
from tidemark.plans import index
from tidemark.sources import files, generators, tables
from tidemark.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_bm25_finds_the_code(spark):
    docs = spark.createDataFrame([(1, "E01 报警 主轴 过热"), (2, "液压 系统 压力 不足")], "doc_id long, text string")
    rows = bm25.search(docs, spark.createDataFrame([(7, 0, "E01 主轴"), (8, 0, ""), (9, 0, "unknown")], "query_id long, ix int, query string")).collect()
    assert [(r.query_id, r.doc_id, r.rank) for r in rows] == [(7, 1, 1)]
    idf = math.log(1 + (2 - 1 + 0.5) / 1.5)
    assert rows[0].score == pytest.approx(3 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 7 / 7.5)), abs=1e-8)


def test_repeated_query_tokens_count_again(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, 0, "a"), (2, 0, "a a")], "query_id long, ix int, query string")
    got = {r.query_id: r.score for r in bm25.search(docs, asked).collect()}
    assert got[2] == pytest.approx(2 * got[1])


def test_understanding(spark):
    rows = [
        (1, "  Check   agent e01  a ", "", [("user", "old"), ("user", "u1"), ("assistant", "no"), ("user", "u2"), ("user", "u3")]),
        (2, "机器 告警 怎么办", "s" * 130, []),
        (3, "one two", "", []),
    ]
    df = query.understand(spark.createDataFrame(rows, "query_id long, query string, summary string, recent array<struct<role:string,content:string>>"))
    got = {r.query_id: r for r in df.collect()}
    assert got[1].primary_query == "Check agent e01 a" and got[1].keywords == ["u1", "u2", "u3", "check", "e01"]
    assert got[1].expanded_queries == ["Check agent e01 a", "u1 u2 u3 check e01", "u1 u2 u3 Check agent e01 a"]
    assert got[2].keywords == ["s" * 130] and got[2].expanded_queries[2] == "s" * 120 + " 机器 告警 怎么办"
    assert got[3].expanded_queries == ["one two"]


def test_fingerprints(spark):
    asked = query.with_fingerprint(query.understand(spark.createDataFrame([(1, "主轴 报错 怎么办?"), (2, "怎么处理 告警：主轴"), (3, "请")], "query_id long, query string")))
    got = {r.query_id: r for r in asked.collect()}
    assert got[1].normalized_query == "主轴 alarm handle" and got[1].query_fingerprint == got[2].query_fingerprint == "alarm|handle|主轴"
    assert got[3].query_fingerprint == "请"


def test_rerank_golden(spark):
    rows = [(1, 1, 0.95, 0.90, 0.030, 1, "E01 spindle overheats", "a.md"), (1, 2, 0.90, 0.80, 0.029, 2, "E01 spindle", "b.md"), (1, 3, 0.20, 0.15, 0.010, 3, "other", "c.md")]
    df = spark.createDataFrame(rows, "query_id long, id long, vector_score double, keyword_score double, fused_score double, rank int, content string, metadata_text string")
    out = ranking.rerank(df.withColumn("keywords", F.array(F.lit("e01"), F.lit("spindle"), F.lit("overheats"))))
    got = [round(r.rerank_score, 6) for r in out.orderBy("position").collect()]
    assert got == [round(0.35 + 0.2375 + 0.18 + 0.15, 6), round(0.35 * 29 / 30 + 0.225 + 0.16 + 0.1, 6), round(0.35 / 3 + 0.05 + 0.03, 6)]
    level = ranking.confidence(df.select("query_id").distinct().union(spark.createDataFrame([(2,)], "query_id long")), out)
    assert {r.query_id: r.confidence for r in level.collect()} == {1: "high", 2: "low"}


def test_rrf_golden(spark):
    make = lambda ids, s: spark.createDataFrame([(1, i, 0.5, [s], k + 1) for k, i in enumerate(ids)], f"query_id long, id string, {s} double, matched_queries array<string>, rank int")
    rows = ranking.fuse(make("abc", "vector_score"), make("bd", "keyword_score")).orderBy("rank").collect()
    assert [r.id for r in rows] == ["b", "a", "d", "c"]
    assert [round(r.fused_score, 7) for r in rows] == [0.0325225, 0.0163934, 0.016129, 0.015873]
    assert rows[0].matched_queries == ["vector_score", "keyword_score"]


def test_merge_keeps_the_better_expansion(spark):
    hits = [(1, 0, 5, 0.5, "q0"), (1, 1, 5, 0.5, "q1"), (1, 2, 5, 0.9, "q2"), (1, 0, 6, 0.7, "q0"), (1, 1, 6, 0.2, "q1")]
    df = spark.createDataFrame(hits, "query_id long, ix int, id long, s double, query string")
    got = {r.id: (r.s, r.matched_queries) for r in ranking.merge_expansions(df, "s", 20).collect()}
    assert got == {5: (0.9, ["q2"]), 6: (0.7, ["q0", "q1"])}


def test_external_rerank(spark):
    candidates = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 30, 3)], "query_id long, id long, rank int")
    response = spark.createDataFrame([(1, 1, 0.91), (1, 0, 0.52), (1, 9, 0.99), (1, 0, 0.4)], "query_id long, index int, relevance_score double")
    rows = ranking.rerank_external(candidates, response).orderBy("position").collect()
    assert [(r.id, r.rerank_score) for r in rows] == [(20, 0.91), (10, 0.52), (30, 0.0)]


def test_embedding_equals_a_plain_loop():
    import hashlib

    def plain(s, dim):
        v = [0.0] * dim
        for c in " ".join(s.split()) or "<empty>":
            h = hashlib.sha256(c.encode()).digest()
            for o in range(0, 32, 4):
                v[int.from_bytes(h[o : o + 4], "big") % dim] += 1.0 if h[o] % 2 == 0 else -1.0
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / n for x in v]

    for s in ["", "a", "aa  b\n", "主轴 E01 😀"]:
        assert np.allclose(vector.embed_text(s, 64), plain(s, 64))
    digest = hashlib.sha256(b"a").digest()
    assert int.from_bytes(digest[:4], "big") % 1024 == 274


def test_nearest_equals_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.integers(-3, 4, 6).astype(float).tolist()) for i in range(300)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = df.where("id < 5").select(F.col("id").alias("query_id"), F.lit(0).alias("ix"), "embedding")
    got = [(x.query_id, x.id, x.rank) for x in vector.nearest(df, asked, 7).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(5):
        near = sorted((sum((a - b) ** 2 for a, b in zip(rows[q][1], v)), i) for i, v in rows if v)[:7]
        want += [(q, i, k + 1) for k, (_, i) in enumerate(near)]
    assert got == want
    assert vector.nearest(df, asked.limit(0), 7).count() == 0
    with pytest.raises(Exception, match="vectors must have 7"):
        vector.check_dim(df.where("id < 3"), "embedding", 7).collect()


@pytest.mark.parametrize("n", [1, 2, 20, 61, 1000])
def test_p95_position(spark, n):
    r = random.Random(n)
    values = [float(r.randrange(max(1, n // 3) if n > 100 else n * 9)) for _ in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", None)], "g string, v double")
    got = {x.g: x.p95 for x in ops.metric_stats(df, "g", "v", 80.0).collect()}
    assert got == {"a": sorted(values)[min(n - 1, int(n * 0.95))], "b": 1.0}


def test_grids_and_ramps(spark):
    asked = spark.sql("SELECT 's' AS service_name, timestamp'2026-02-14 10:00:00' AS start, timestamp'2026-02-14 11:00:00' AS end, '5m' AS interval")
    rows = generators.metric_points(asked).orderBy("ix").collect()
    assert len(rows) == 13 and rows[-1].timestamp == "11:00" and [r.value for r in rows[:5]] == [10.0, 10.5, 11.0, 18.5, 27.0] and rows[-1].value == 95.0
    memory_rows = generators.metric_points(asked, "memory").orderBy("ix").collect()
    assert memory_rows[12].value == 85.0 and memory_rows[12].used_gb == 6.8
    assert generators.log_lines(spark, 0, 600_000, 5).count() == 5 and generators.log_lines(spark, 60_000, 0).count() == 0
    assert [one(spark, scores.interval_minutes(F.lit(x))) for x in ("7m", "2h", "3d")] == [7, 120, 1]
    assert one(spark, scores.parse_time(F.lit("2026-02-14 10:00:00"))).hour == 10 and one(spark, scores.parse_time(F.lit("bad"))) is not None


def test_sections_of_pages(spark):
    pages = spark.createDataFrame([(1, " intro \n\n故障现象\nstep one\n 处理步骤： \n1. x\n流程说明\nz"), (2, ""), (3, None)], "page_id long, text string")
    rows = chunking.page_sections(pages).orderBy("section").collect()
    assert [(r.title, r.chunk_type, r.content) for r in rows] == [("正文", "pdf_text", "intro"), ("故障现象", "fault_symptom", "故障现象\nstep one\n处理步骤：\n1. x"), ("流程说明", "pdf_section", "流程说明\nz")]


def test_merging_small_chunks(spark):
    parts = [(1, i, "x" * n) for i, n in enumerate([500, 100, 1200, 50, 700])]
    rows = chunking.merge_small(spark.createDataFrame(parts, "doc_id long, piece int, content string"), "doc_id").orderBy("chunk_index").collect()
    assert [len(r.content) for r in rows] == [602, 1252, 700]
    pages = [(1, 0, 1, "s", "a" * 300), (1, 1, 1, "s", "b" * 20), (1, 2, 2, "s", "c"), (1, 3, 2, "t", "d"), (1, 4, 2, "t", "e")]
    rows = chunking.merge_page_pieces(spark.createDataFrame(pages, "doc_id long, piece int, page_number int, section_path string, content string"), "doc_id").orderBy("chunk_index").collect()
    assert [r.content for r in rows] == ["a" * 300 + "\n" + "b" * 20, "c", "d\ne"]


def test_the_first_piece_keeps_its_columns(spark):
    parts = [(1, 0, "A", "x" * 400), (1, 1, "B", "y" * 10), (1, 2, "C", "z" * 400)]
    rows = chunking.merge_small(spark.createDataFrame(parts, "doc_id long, piece int, section_path string, content string"), "doc_id", ("section_path",)).orderBy("chunk_index").collect()
    assert [(r.section_path, len(r.content)) for r in rows] == [("A", 412), ("C", 400)]


def test_pages_are_split_by_titles_at_any_line_end(spark):
    pages = spark.createDataFrame([("/tmp/Repair.pdf", 1, "故障现象\n设备启动失败，控制面板报码 E01。\n处理步骤\n1. 检查电源。\n2. 检查保险丝。\n"), ("/tmp/Repair.pdf", 2, "intro\n处理\u3000步骤\u2028a\f故障现象\nb\x85c"), ("/tmp/Repair.pdf", 3, None)], "source_path string, page_number int, text string")
    rows = chunking.split_pages(pages).orderBy("chunk_index").collect()
    assert [(r.page_number, r.section_path, r.chunk_type, r.content) for r in rows] == [
        (1, "故障现象", "fault_symptom", "故障现象\n设备启动失败，控制面板报码 E01。"),
        (1, "处理步骤", "repair_steps", "处理步骤\n1. 检查电源。\n2. 检查保险丝。"),
        (2, "正文", "pdf_text", "intro"),
        (2, "处理\u3000步骤", "pdf_section", "处理\u3000步骤\na"),
        (2, "故障现象", "fault_symptom", "故障现象\nb\nc"),
    ]
    docs = spark.createDataFrame([("/d/a.md", "# T\ntext"), ("/d/b.txt", "plain"), ("/tmp/Repair.pdf", "ignored"), ("/d/none", "bare")], "source_path string, text string")
    out = {(r.source_path, r.chunk_index): r for r in chunking.split_documents(docs, pages).collect()}
    assert len(out) == 8 and out["/tmp/Repair.pdf", 0].extension == ".pdf" and out["/tmp/Repair.pdf", 0].file_name == "Repair.pdf" and out["/tmp/Repair.pdf", 0].chunk_key == "/tmp/Repair.pdf::0"
    assert out["/d/a.md", 0].section_path == "T" and out["/d/a.md", 0].chunk_type == "markdown" and out["/d/none", 0].extension == ""


def test_confidence_reasons_references_and_debug(spark):
    import json

    rows = [(1, 1, 0.95, 0.90, 0.030, 1, "E01 spindle overheats", "a.md", "a.md", 3, " S "), (1, 2, 0.90, 0.80, 0.029, 2, "E01 spindle", "b.md", None, 0, ""), (1, 3, 0.20, 0.15, 0.010, 3, "other", "c.md", "c.md", None, None), (3, 4, 0.6, 0.6, 0.03, 1, "E01", "d.md", "d.md", 1, None)]
    df = spark.createDataFrame(rows, "query_id long, id long, vector_score double, keyword_score double, fused_score double, rank int, content string, metadata_text string, file_name string, page_number int, section_path string")
    ranked = ranking.rerank(df.withColumn("keywords", F.array(F.lit("e01"), F.lit("spindle"), F.lit("overheats"))).withColumn("matched_queries", F.array(F.lit("q"))))
    levels = ranking.confidence(spark.createDataFrame([(1,), (2,), (3,), (None,)], "query_id long"), ranked)
    got = {r.query_id: r for r in ranking.explain(levels, ranked).collect()}
    assert {k: v.confidence for k, v in got.items()} == {1: "high", 2: "low", 3: "medium", None: "low"}
    assert got[1].reason == "" and got[2].reason == ranking.NOTHING_FOUND and got[3].reason == f"{ranking.SOME_SUPPORT}: top1=0.670, support=1, avg_top3=0.670"
    debug = json.loads(got[1].confidence_debug)
    assert debug["supportCount"] == 2 and debug["strongSupportCount"] == 2 and debug["thresholds"]["overallHigh"] == 0.78 and [c["id"] for c in debug["candidates"]] == ["1", "2", "3"]
    assert json.loads(got[2].confidence_debug)["candidates"] == [] and "thresholds" not in json.loads(got[2].confidence_debug)
    assert [r.file_name for r in got[1].references] == ["a.md", "未知来源", "c.md"] and got[1].references[0].confidence == "high"
    assert got[1].reference_list.split("\n")[:2] == ["[1] a.md / 第3页 / S (score=0.9175, confidence=high)", "[2] 未知来源 (score=0.8233, confidence=high)"]
    assert got[3].context_text == "【证据 1】\n来源: d.md / 第1页\n文档置信度: medium\n重排来源: local\n重排分数: 0.670 (raw=0.670)\nE01" and got[2].context_text == ""
    shown = {r.position: r for r in ranking.documents(ranked.where("query_id = 1")).collect()}
    assert shown[1].content == "E01 spindle overheats" and shown[1].metadata["rerank_source"] == "local" and shown[1].metadata["page_number"] == "3" and "file_name" not in shown[2].metadata


def test_a_failing_embedder_falls_back_and_blank_queries_fail(spark):
    df = spark.createDataFrame([(1, "a"), (2, " ")], "id long, text string")

    def broken(texts):
        raise RuntimeError

    got = {r.id: r.embedding for r in vector.embed(df, ["id"], dim=16, embedder=broken).collect()}
    assert np.allclose(got[1], vector.embed_text("a", 16)) and len(got[2]) == 16
    assert vector.embed(df, ["id"], embedder=lambda ts: [[1.0, 2.0]] * len(ts)).first().embedding == [1.0, 2.0]
    with pytest.raises(Exception, match="must not be blank"):
        vector.embed(df, ["id"], queries=True).collect()


def test_ties_at_rounded_distances_go_to_the_smaller_id(spark):
    rows = [(i, [1.0 + (i % 3) * 1e-12, 0.0]) for i in range(40, 0, -1)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(1, 0, [0.0, 0.0])], "query_id long, ix int, embedding array<double>")
    assert [r.id for r in vector.nearest(df, asked, 5, decimals=9).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_an_index_serves_after_the_corpus_is_gone(spark, tmp_path):
    docs = spark.createDataFrame([(1, "E01 报警"), (2, "液压"), (3, None)], "doc_id long, text string")
    bm25.build(docs, path=str(tmp_path / "ix"))
    asked = spark.createDataFrame([(7, 0, "e01"), (8, 0, "none")], "query_id long, ix int, query string")
    loaded = bm25.load(spark, str(tmp_path / "ix"))
    got = [(r.query_id, r.doc_id, r.score) for r in bm25.search(loaded, asked).collect()]
    assert got == [(r.query_id, r.doc_id, r.score) for r in bm25.search(docs, asked).collect()] and len(got) == 1 and loaded.n_docs == 3
    assert bm25.search(docs.limit(0), asked).count() == 0


def test_lookups_lists_and_rebuilds(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "a::1", 7, 1), (2, "a::0", 7, 0), (3, "b::0", 8, 0)], "id long, chunk_key string, document_id long, chunk_index int")
    assert governance.chunk_by_key(chunks, "a::1").first().id == 1 and governance.chunk_by_id(chunks, 9).count() == 0
    assert [r.id for r in governance.chunks_of_document(chunks, 7).collect()] == [2, 1]
    history = spark.createDataFrame([(1, 2, "2026-01-01"), (1, 3, "2026-01-02"), (1, 3, "2026-01-03"), (2, 5, "2026-01-01")], "chunk_id long, version_no int, created_at string")
    assert [(r.version_no, r.created_at[-1]) for r in governance.history_of_key(history, chunks, "a::1").collect()] == [(3, "3"), (3, "2"), (2, "1")]
    late = governance.history_of_key(history, chunks, "z")  # no job yet
    with pytest.raises(Exception, match="no chunk z"):
        late.collect()
    assert governance.document_by_source(spark.createDataFrame([("kb", "/a", 1), ("other", "/a", 2)], "collection_name string, source_path string, id long"), "kb", "/a").first().id == 1
    for name in ("b.txt", "a.md", "c.pdf", "d.png"):
        (tmp_path / name).write_text("x")
    assert [r.source_path.rsplit("/")[-1] for r in files.files_to_index(spark, str(tmp_path)).collect()] == ["a.md", "b.txt", "c.pdf"]
    assert one(spark, files.backup_name("kb", F.lit("2026-01-02 03:04:05").cast("timestamp"))) == "kb_legacy_20260102030405"
    good, bad = spark.range(3).select(F.col("id").cast("string").alias("source_path")), spark.createDataFrame([("x", "broken")], "source_path string, error string")
    row = files.job_counters(good, bad, F.current_timestamp()).first()
    assert (row.total, row.success, row.failed, row.all_good) == (4, 3, 1, False) and row.duration_ms >= 0
    rows = spark.createDataFrame([(1, '{"_source": "p"}'), (2, '{"_source": "q"}'), (3, None), (4, "{")], "id long, metadata string")
    assert [r.id for r in files.delete_by_source(rows, "p").orderBy("id").collect()] == [2, 3, 4]
    line = one(spark, files.to_json_line(F.struct(F.lit("主轴").alias("content"), F.lit(None).cast("int").alias("page_number"))))
    assert line == '{"content":"主轴"}' and one(spark, files.from_json_line(F.lit(line), "content string")).content == "主轴"
    corpus = spark.createDataFrame([("p", "x"), ("q", "y")], "_source string, content string")
    path = str(tmp_path / "corpus.jsonl")
    files.write_corpus(corpus, path)
    files.write_corpus(files.remove_source(files.read_corpus(spark, path), "p").select("_source", "content"), path)
    assert [r.content for r in files.read_corpus(spark, path).collect()] == ["y"]


def test_latest_rows_of_an_appended_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 2), (2, "c", 1)], "id long, v string, batch long")
    rows.write.partitionBy("batch").parquet(str(tmp_path / "t"))
    assert sorted((r.id, r.v) for r in ingest.latest(spark, str(tmp_path / "t"), ["id"]).collect()) == [(1, "b"), (2, "c")]


def test_a_reranker_is_asked_a_query_at_a_time_and_may_fail(spark):
    assert ranking.use_online(True, " Cohere ", "k") and not any(ranking.use_online(*x) for x in [(False, "cohere", "k"), (True, "local", "k"), (True, "cohere", "")])
    rows = [(1, 1, 0.9, 0.9, 0.03, 1, "x", "m", "good"), (1, 2, 0.1, 0.1, 0.01, 2, "y", "m", "good"), (2, 3, 0.9, 0.9, 0.03, 1, "x", "m", "bad"), (2, 4, 0.1, 0.1, 0.01, 2, "y", "m", "bad")]
    df = spark.createDataFrame(rows, "query_id long, id long, vector_score double, keyword_score double, fused_score double, rank int, content string, metadata_text string, query string").withColumn("keywords", F.array(F.lit("x")))

    def reranker(query, texts):
        return [0.2 if t == "x" else 1.7 for t in texts] if query == "good" else [1.0]

    got = [(r.query_id, r.id, r.rerank_source, r.rerank_score) for r in ranking.rerank_with(df, reranker).orderBy("query_id", "position").collect()]
    assert got[:2] == [(1, 2, "online", 1.0), (1, 1, "online", 0.2)] and [x[1:3] for x in got[2:]] == [(3, "local"), (4, "local")]


def test_a_folder_is_indexed_and_indexed_again(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    (folder / "a.md").write_text("# T\ntext", "utf-8")
    (folder / "b.txt").write_text("plain", "utf-8")
    (folder / "c.pdf").write_bytes("处理步骤\n1. x\f \f故障现象\ny".encode())
    (folder / "d.pdf").write_bytes(b"broken")
    (folder / "e.txt").write_bytes(b"\xff\xfe\xff")
    (folder / "f.pdf").write_bytes(b" ")

    def read_pdf(content):
        if content == b"broken":
            raise ValueError("not a document")
        return content.decode().split("\f")

    row = index.index_directory(spark, str(folder), root, read_pdf).first()
    assert (row.total, row.success, row.failed, row.all_good) == (6, 3, 3, False) and row.duration_ms > 0
    got = {(r.file_name, r.chunk_index): (r.page_number, r.section_path, r.content) for r in tables.read(spark, root).collect()}
    assert got == {("a.md", 0): (None, "T", "# T\ntext"), ("b.txt", 0): (None, None, "plain"), ("c.pdf", 0): (1, "处理步骤", "处理步骤\n1. x"), ("c.pdf", 1): (3, "故障现象", "故障现象\ny")}
    (folder / "b.txt").write_text("changed", "utf-8")
    index.index_directory(spark, str(folder), root)
    again = {(r.file_name, r.chunk_index): r.content for r in tables.read(spark, root).collect()}
    assert len(again) == 4 and again["b.txt", 0] == "changed" and again["c.pdf", 1] == "故障现象\ny"


def test_documents_of_blank_pages_are_reported(spark):
    pages = spark.createDataFrame([("a", 1, " \u3000"), ("a", 2, None), ("b", 1, "x"), ("b", 2, "")], "source_path string, page_number int, text string")
    assert [r.source_path for r in files.blank_documents(pages).collect()] == ["a"] and files.scan_pages(pages).count() == 1


def test_markdown_sections(spark):
    md = "pre\n# A\ntext\n## B\nb\n### C\nc\n```\n# no\n```\n# D\n## \nd"
    rows = chunking.markdown_sections(spark.createDataFrame([(1, md)], "doc_id long, text string")).orderBy("section").collect()
    assert [(r.section_path, r.content) for r in rows] == [("", "pre"), ("A", "# A\ntext"), ("A > B", "## B\nb\n### C\nc\n```\n# no\n```"), ("D", "# D\n## \nd")]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n。", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_recursive_split_invariants(s, size, overlap):
    chunks = chunking.split_text(s, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    left = Counter(c for c in s if not c.isspace())
    assert not left - Counter(c for k in chunks for c in k)  # nothing is lost
    if overlap == 0:
        assert "".join("".join(chunks).split()) == "".join(s.split())


def test_memory_compaction():
    assert memory.compact("old", [], None) == "old"
    assert memory.compact("", [("user", "hi"), ("assistant", "yo")]) == "user: hi\nassistant: yo"
    assert memory.compact("a", [("user", "x")], lambda p: " s" * 2000)[:3] == "s s" and len(memory.compact("a", [("user", "x" * 5000)])) == 1200
    assert memory.compact("a", [("user", "x")], lambda p: 1 / 0) == "a\nuser: x"


def test_publish_and_upsert(spark):
    schema = "id long, chunk_key string, published_text string, draft_text string, published_version int, sync_status string, last_publish_error string"
    chunks = spark.createDataFrame([(1, "a", "t1", "d1", 1, "draft", None), (2, "b", "t2", None, 3, "synced", None), (3, "c", "t3", "d3", 2, "draft", "old")], schema)
    edits = spark.createDataFrame([("a", "me", "n"), ("b", "me", None)], "chunk_key string, editor string, edit_note string")
    after, history = governance.publish(chunks, edits)
    got = {r.chunk_key: r for r in after.collect()}
    assert (got["a"].published_text, got["a"].published_version, got["a"].draft_text, got["a"].sync_status) == ("d1", 2, None, "synced")
    assert (got["b"].sync_status, got["b"].last_publish_error, got["b"].published_version) == ("publish_failed", "empty draft", 3)
    assert (got["c"].draft_text, got["c"].sync_status, got["c"].last_publish_error) == ("d3", "draft", "old")
    assert [(r.chunk_id, r.version_no, r.old_text, r.new_text) for r in history.collect()] == [(1, 2, "t1", "d1")]
    parents = chunks.select("id").where("id = 1")
    kids = spark.createDataFrame([(1, 5), (2, 6), (None, 7)], "fk long, v int")
    assert sorted(r.v for r in governance.cascade(kids, parents, "fk").collect()) == [6, 7]
    assert {r.v: r.fk for r in governance.set_null(kids, parents, "fk").collect()} == {5: None, 6: 2, 7: None}


def test_files_and_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# x", encoding="utf-8")
    (tmp_path / "in/b.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "in/c.bin").write_text("no")
    good, bad = files.scan_directory(spark, str(tmp_path / "in"))
    assert [(r.file_name, r.file_ext, r.text) for r in good.collect()] == [("a.md", ".md", "# x")] and bad.count() == 1
    assert tuple(files.job_counters(good, bad).first())[:3] == (2, 1, 1)
    (tmp_path / "c.jsonl").write_text('{"content": "x", "_source": "s"}\n\nbroken{\n{"content": "y"}\n')
    corpus = files.read_corpus(spark, str(tmp_path / "c.jsonl"))
    assert sorted(r.content for r in files.remove_source(corpus, "s").collect()) == ["y"]
    assert files.collection_path("data/rag.jsonl", "a b/c") == "data/rag_a_b_c.jsonl"
    root = f"file://{tmp_path}/t"
    assert tables.current_version(spark, root) == 0
    tables.publish(spark.range(3), root)
    tables.publish(spark.range(5), root)
    assert tables.read(spark, root).count() == 5 and tables.read(spark, root, 1).count() == 3
    assert tables.rebuild(spark, root, spark.range(7), root + "_old").first().n_rows == 7
    with pytest.raises(ValueError):
        tables.rebuild(spark, root, spark.range(7), root + "_old")


def test_scalars(spark):
    assert one(spark, text.mask_secret(F.lit("sk-1234567890abcd"))) == "sk-12345...abcd" and one(spark, text.mask_secret(F.lit("short"))) == "***"
    assert one(spark, text.section_path(F.lit("a"), F.lit(""), F.lit("c"))) == "a > c"
    assert one(spark, text.optional_int(F.lit("x"))) is None and one(spark, text.optional_double(F.lit("1.5"))) == 1.5
    assert one(spark, scores.label(F.lit(0.45), 0.75, 0.45)) == "medium"
    assert [one(spark, files.upload_errors(F.lit(n), F.lit(s))) for n, s in [("a.md", 5), ("a.exe", 5), ("", 5), ("a.txt", 1 << 30)]] == [None, "extension", "no name", "size"]


def test_nearest_ties_go_to_the_smaller_id(spark):
    ids = [(i * 37) % 101 for i in range(101)]  # copies of one vector, far more than k, in no order
    rows = [(i, [0.6, 0.8, 0.1]) for i in ids] + [(500 + i, [0.5, 0.8, 0.1]) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = spark.createDataFrame([(1, 0, [0.5, 0.8, 0.1]), (2, 0, [0.6, 0.9, 0.1])], "query_id long, ix int, embedding array<double>")
    for parts in (1, 4):
        got = {}
        for x in vector.nearest(df.coalesce(1) if parts == 1 else df.repartition(parts), asked, 6).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append(x.id)
        assert got == {1: [500, 501, 502, 0, 1, 2], 2: [0, 1, 2, 3, 4, 5]}
