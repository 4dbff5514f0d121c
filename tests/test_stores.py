"""Tables of buckets, the log of edits, the relational store and streaming state."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators import bm25, vector
from tidemark.plans import functions as tools
from tidemark.plans import index, publishing, retrieve
from tidemark.sources import collection, relational, tables
from tidemark.sources.tables import Buckets
from tidemark.streaming import ingest
from tidemark.streaming.memory import CLEAR, session_memory, state_store


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_an_upsert_touches_only_its_buckets(spark, tmp_path):
    table = Buckets(f"file://{tmp_path}/t", ("id", "part"), 32)
    whole = spark.range(500).select("id", F.when(F.col("id") % 5 > 0, "a").alias("part"), F.lit("old").alias("v"), F.lit(1).alias("made"))
    table.upsert(whole)
    assert rows_of(table.read(spark)) == rows_of(whole)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("bucket=*/*.parquet")}
    new = spark.createDataFrame([(7, "a", "new", 2), (10, None, "new", 2), (7000, "a", "new", 2)], "id long, part string, v string, made int")
    text = table.merged(new)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in text or "PartitionFilters: [isnotnull(bucket" in text
    for _ in range(2):  # a repeated upsert changes nothing
        table.upsert(new, keep=("made",))
        got = {(r.id, r.part): (r.v, r.made) for r in table.read(spark).where("v = 'new' OR id = 8").collect()}
        assert got == {(7, "a"): ("new", 1), (10, None): ("new", 1), (7000, "a"): ("new", 2), (8, "a"): ("old", 1)}
        assert table.read(spark).count() == 501
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("bucket=*/*.parquet")}
    touched = {p.parent.name for p in set(before) ^ set(after)}
    assert 1 <= len(touched) <= 3 and all(after[p] == t for p, t in before.items() if p in after)


def test_a_stream_upserts_into_buckets(spark, tmp_path):
    table = Buckets(f"file://{tmp_path}/t", ("id",), 8)
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, None)]):
        spark.createDataFrame(rows, "id long, v string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        ingest.ingest(ingest.read_stream(spark, f"file://{tmp_path}/in", "id long, v string"), table, f"{tmp_path}/check")
    assert sorted((r.id, r.v) for r in table.read(spark).collect()) == [(1, "a"), (2, "c"), (3, None)]


CHUNK = "id long, chunk_key string, published_text string, draft_text string, published_version int, sync_status string, last_publish_error string"


def base_of(spark):
    return spark.createDataFrame([(1, "a", "old pump", "new valve", 1, "draft", None), (2, "b", "gear", None, 3, "synced", None), (3, "c", "belt", "chain", 2, "draft", "x")], CHUNK)


def edits_of(spark, *keys):
    return spark.createDataFrame([(k, "me", "note") for k in keys], "chunk_key string, editor string, edit_note string")


def seen(spark, base, root):
    """All that readers see: texts, history, vectors, hits."""
    docs = base.select(F.col("id").alias("doc_id"), F.col("published_text").alias("text"))
    vectors = vector.embed(base.select("id", F.col("published_text").alias("text")), ["id"], dim=16)
    own = publishing.view(base, root, vectors, bm25.build(docs))
    asked = spark.createDataFrame([(1, 0, "valve"), (2, 0, "pump"), (3, 0, "chain")], "query_id long, ix int, query string")
    texts = {r.chunk_key: (r.published_text, r.draft_text, r.published_version, r.sync_status, r.last_publish_error) for r in own.chunks.collect()}
    history = sorted((r.chunk_id, r.version_no, r.old_text, r.new_text, r.editor) for r in own.history.collect())
    embedded = {r.id: [round(x, 6) for x in r.embedding] for r in own.vectors.collect()}
    found = sorted((r.query_id, r.doc_id, r.score) for r in bm25.search(own.keywords, asked).collect())
    return texts, history, embedded, found


SMALL = Settings(embedding_dim=16)


def test_publishing_reaches_every_reader(spark, tmp_path):
    base, root = base_of(spark), f"file://{tmp_path}/edits"
    entry = publishing.publish(base, root, edits_of(spark, "a", "b", "zz"), settings=SMALL)
    assert sorted((r.chunk_key, r.action, r.error) for r in entry.collect()) == [("a", "published", None), ("b", "publish_failed", "empty draft")]
    publishing.save_drafts(base, root, spark.createDataFrame([("b", " gear box "), ("a", "  "), ("zz", "x")], "chunk_key string, draft string"))
    publishing.publish(base, root, edits_of(spark, "b"), settings=SMALL)
    texts, history, embedded, found = seen(spark, base, root)
    assert texts == {"a": ("new valve", None, 2, "synced", None), "b": ("gear box", None, 4, "synced", None), "c": ("belt", "chain", 2, "draft", "x")}
    assert history == [(1, 2, "old pump", "new valve", "me"), (2, 4, "gear", "gear box", "me")]
    after = spark.createDataFrame([(1, "new valve"), (2, "gear box"), (3, "belt")], "doc_id long, text string")
    plain = vector.embed(after.withColumnRenamed("doc_id", "id"), ["id"], dim=16)
    assert embedded == {r.id: [round(x, 6) for x in r.embedding] for r in plain.collect()}
    asked = spark.createDataFrame([(1, 0, "valve"), (2, 0, "pump"), (3, 0, "chain")], "query_id long, ix int, query string")
    assert found == sorted((r.query_id, r.doc_id, r.score) for r in bm25.search(after, asked).collect())


@pytest.mark.parametrize("step", ["write", "commit"])
def test_a_failure_leaves_every_reader_on_the_old_state(spark, tmp_path, monkeypatch, step):
    base, root = base_of(spark), f"file://{tmp_path}/edits"
    publishing.publish(base, root, edits_of(spark, "a"), settings=SMALL)
    before = seen(spark, base, root)
    with monkeypatch.context() as m:
        if step == "commit":
            m.setattr(publishing, "commit", lambda *_: 1 / 0)
        else:
            m.setattr(publishing.vector, "embed", lambda *_: 1 / 0)
        with pytest.raises((ZeroDivisionError, TypeError)):
            publishing.publish(base, root, edits_of(spark, "c"), settings=SMALL)
    assert seen(spark, base, root) == before
    publishing.publish(base, root, edits_of(spark, "c"), settings=SMALL)
    assert seen(spark, base, root)[0]["c"][:3] == ("chain", None, 3)


def test_two_writers_publish_a_draft_once(spark, tmp_path, monkeypatch):
    base, root = base_of(spark), f"file://{tmp_path}/edits"
    commit, raced = publishing.commit, []

    def late(spark_, root_, number, name):
        if not raced:  # another writer is first
            raced.append(1)
            publishing.publish(base, root, edits_of(spark, "a"), settings=SMALL)
        return commit(spark_, root_, number, name)

    monkeypatch.setattr(publishing, "commit", late)
    entry = publishing.publish(base, root, edits_of(spark, "a"), settings=SMALL)
    assert [(r.action, r.error) for r in entry.collect()] == [("publish_failed", "empty draft")]
    own = publishing.view(base, root)
    assert own.history.count() == 1 and own.chunks.where("chunk_key = 'a'").first().published_version == 2
    assert len(list((tmp_path / "edits/entries").glob("[0-9a-f]*"))) == 2


def test_claims_are_won_once(spark, tmp_path):
    path = f"file://{tmp_path}/x/1"
    assert tables.claim(spark, path, "one") and not tables.claim(spark, path, "two") and tables.told(spark, path) == "one"
    assert [p.name for p in (tmp_path / "x").iterdir() if not p.name.startswith(".")] == ["1"]
    assert tables.children(spark, f"file://{tmp_path}/none") == []


def test_a_table_is_there_while_it_is_rebuilt(spark, tmp_path, monkeypatch):
    folder, root = tmp_path / "in", f"file://{tmp_path}/t"
    folder.mkdir()
    (folder / "b.txt").write_text("one")
    (folder / "a.txt").write_text("two")
    (folder / "bad.txt").write_bytes(b"\xff")
    tables.publish(spark.createDataFrame([(1,)], "id long"), root)
    publish, during = tables.publish, []
    monkeypatch.setattr(tables, "publish", lambda df, to, *a: (during.append(tables.read(spark, root).columns), publish(df, to, *a))[1])
    summary, each = index.rebuild_directory(spark, str(folder), root, root + "_old")
    row = summary.first()
    assert during == [["id"], ["id"]] and (row.backup, row.n_rows, row.total, row.failed) == (root + "_old", 2, 3, 1)
    assert [(r.source_path.rsplit("/")[-1], r.n_chunks, r.error) for r in each.collect()] == [("a.txt", 1, None), ("b.txt", 1, None), ("bad.txt", 0, "not UTF-8")]
    assert tables.read(spark, root + "_old").columns == ["id"]


def test_relational_store(spark):
    url = "jdbc:derby:memory:store;create=true"
    relational.execute(spark, url, 'CREATE TABLE chunks ("id" BIGINT PRIMARY KEY, "text" CLOB, "n" INT CHECK ("n" < 100))')
    rows = spark.range(100).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit(1).alias("n"))
    relational.append(rows, url, "chunks", parts=2)
    parts = relational.read(spark, url, "chunks", bounds=("id", 0, 100, 4))
    assert parts.rdd.getNumPartitions() == 4 and rows_of(parts) == rows_of(rows)
    assert relational.read(spark, url, "chunks", predicates=['"id" < 10', '"id" >= 10']).rdd.getNumPartitions() == 2
    some = relational.read(spark, url, "chunks").where("id = 7").select("text")
    assert "EqualTo(id,7)" in some._jdf.queryExecution().executedPlan().toString() and some.first().text == "t7"
    new = spark.createDataFrame([(7, "seven", 2), (200, None, 3)], "id long, text string, n int")
    assert relational.upsert(new, url, "chunks", ["id"]) == 2
    got = {r.id: (r.text, r.n) for r in relational.read(spark, url, "chunks").collect()}
    assert len(got) == 101 and got[7] == ("seven", 2) and got[200] == (None, 3) and got[8] == ("t8", 1)
    bad = spark.createDataFrame([(8, "x", 1), (9, "y", 100)], "id long, text string, n int")
    with pytest.raises(Exception):
        relational.upsert(bad, url, "chunks", ["id"])
    assert relational.read(spark, url, "chunks").where("id = 8").first().text == "t8"
    left = relational.read(spark, url, "(SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLENAME LIKE 'STAGING%') t")
    assert left.count() == 0  # staging tables are gone
    with pytest.raises(Exception):
        relational.execute(spark, url, 'DELETE FROM chunks WHERE "id" = 8', "no statement")
    assert relational.read(spark, url, "chunks").count() == 101  # rolled back
    assert relational.health(spark, url, "VALUES 1").first().healthy
    row = relational.health(spark, "jdbc:derby:memory:none", "VALUES 1").first()
    assert not row.healthy and "none" in row.error


MESSAGE = "session_id long, turn long, role string, text string"


def test_session_state_over_batches(spark, tmp_path):
    batches = [
        [(1, t, "user", f"m{t}") for t in range(3)] + [(2, 0, "user", "x")],
        [(1, t, "assistant", f"m{t}") for t in range(3, 6)],  # restart from the checkpoint
        [(1, 6, CLEAR, None), (1, 7, "user", "anew"), (2, 1, CLEAR, None), (2, 2, "user", None)],
    ]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for rows in batches:
        spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        with state_store(spark):
            stream = ingest.read_stream(spark, f"file://{tmp_path}/in", MESSAGE)
            ingest.run_to_table(session_memory(stream, Settings(window_rounds=1)), f"file://{tmp_path}/out", f"{tmp_path}/check")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    got = {(r.batch, r.session_id): (r.n_messages, r.n_kept, r.summary, r.last_turn) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {
        (0, 1): (3, 2, "user: m0", 2),
        (0, 2): (1, 1, "", 0),
        (1, 1): (6, 2, "user: m0\nuser: m1\nuser: m2\nassistant: m3", 5),
        (2, 1): (1, 1, "", 7),
        (2, 2): (1, 1, "", 2),
    }


def test_a_collection_of_vectors(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    own = collection.create(spark, root, 2, buckets=4)
    assert own.load(spark).count() == 0 and own.delete_source(spark, "p") == 0
    kind = "id long, content string, metadata string, embedding array<double>"
    own.write(spark.createDataFrame([(i, "x", '{"_source": "%s"}' % "pq"[i % 2], [1.0, float(i)]) for i in range(20)], kind))
    own.write(spark.createDataFrame([(3, "y", None, [0.0, 0.0]), (50, "z", "{", [5.0, 5.0])], kind))
    with pytest.raises(Exception, match="2 numbers"):
        own.write(spark.createDataFrame([(4, "w", None, [1.0])], kind))
    assert own.delete_source(spark, "p") == 10 and own.delete_source(spark, "p") == 0
    got = {r.id: (r.content, r.embedding) for r in collection.create(spark, root, 2).load(spark).collect()}
    assert set(got) == {*range(1, 20, 2), 50} and got[3] == ("y", [0.0, 0.0]) and got[5] == ("x", [1.0, 5.0])
    assert own.delete_source(spark, "q") == 9 and {r.id for r in own.load(spark).collect()} == {3, 50}
    with pytest.raises(ValueError, match="2 numbers"):
        collection.create(spark, root, 3)


def test_embeddings_have_one_width(spark):
    def odd(texts):
        if "bad" in texts:
            raise ValueError
        return [[1.0] * (3 if "wide" in texts else 2) for _ in texts]

    got = {}
    for text in ("good", "bad", "wide"):  # batches of their own
        df = spark.createDataFrame([(1, text)], "id long, text string")
        got[text] = vector.embed(df, ["id"], dim=2, embedder=odd).first().embedding
    assert got["good"] == [1.0, 1.0] and {len(v) for v in got.values()} == {2}


def test_sql_functions(spark):
    tools.register_time(spark)
    row = spark.sql("SELECT now_text() AS a, now_text('UTC') AS b, now_ms() AS c").first()
    assert len(row.a) == 19 and row.a[:4] == row.b[:4] and abs(row.c / 1000 - time.time()) < 60
    logs = spark.createDataFrame([(i, i * 1000, "t" if i % 2 else None, "INFO", f"m{i}") for i in range(10)], "event_id long, ms long, topic string, level string, message string")
    tools.register_logs(logs.withColumn("ts", F.timestamp_millis("ms")))
    ask = lambda call: [r.event_id for r in spark.sql(f"SELECT * FROM {call} ORDER BY ts").collect()]
    assert ask("search_log('t', 1000, 7000, 3)") == [1, 3, 5] and ask("search_log('t', 1001, 7000)") == [3, 5, 7]
    assert ask("search_log(NULL, 0, 2000)") == [0, 1, 2] and ask("search_log('none', 0, 9000)") == [] == ask("search_log('t', 5000, 1000)")
    plan = spark.sql("SELECT * FROM search_log('t', 0, 9000, 5)")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=5" in plan
    points = [("s", "cpu", i * 1000, float(v)) for i, v in enumerate([10, 20, 90, 90, 30])] + [("s", "memory", 0, 50.0)] + [("many", "cpu", i, float(i)) for i in range(1, 21)]
    tools.register_metrics(spark.createDataFrame(points, "service string, metric string, ms long, value double").withColumn("ts", F.timestamp_millis("ms")))
    one = lambda *a: spark.sql(f"SELECT * FROM metric_report({', '.join(map(repr, a))})").first()
    assert tuple(one("cpu", "s", 0, 9000))[:7] == (5, 48.0, 90.0, 10.0, 90.0, 80.0, True) and one("cpu", "many", 0, 9000).p95 == 20.0
    assert tuple(one("memory", "s", 0, 9000))[:7] == (1, 50.0, 50.0, 50.0, 50.0, 70.0, False) and one("cpu", "none", 0, 9000).n == 0
    docs = spark.createDataFrame([(1, "red pump pump", "a"), (2, "blue pump", "b"), (3, "gear", None)], "doc_id long, text string, source string")
    tools.register_search(bm25.build(docs), docs)
    got = [(r.place, r.doc_id, r.score) for r in spark.sql("SELECT * FROM search_knowledge(:q) ORDER BY place", {"q": "Pump, pump it's red"}).collect()]
    asked = spark.createDataFrame([(1, 0, "Pump, pump it's red")], "query_id long, ix int, query string")
    assert got == [(r["rank"], r.doc_id, r.score) for r in bm25.search(docs, asked).orderBy("rank").collect()] and len(got) == 2
    assert spark.sql("SELECT * FROM search_knowledge('nothing', 5)").count() == 0


def test_the_answering_tool(spark):
    docs = spark.createDataFrame([(1, "E01 spindle overheats check the coolant", "a.md"), (2, "hydraulic pressure low", "b.md")], "doc_id long, text string, source string")
    asked = spark.createDataFrame([(1, "E01 spindle overheats"), (2, "zzz qqq")], "query_id long, query string")
    got = {r.query_id: r for r in retrieve.retrieve_knowledge(docs, asked).collect()}
    lines = got[1].tool_text.split("\n")
    assert lines[0] == f"检索整体置信度: {got[1].confidence}" and lines[1] == "重排来源: local" and any(x.startswith("置信度统计: top1=") for x in lines)
    assert "【证据 1】" in got[1].tool_text and "spindle overheats check" in got[1].tool_text and got[1].references[0].score > got[2].references[0].score
    nothing = retrieve.retrieve_knowledge(docs.limit(0), asked).first()
    assert nothing.tool_text == "没有找到相关信息。" and nothing.confidence == "low"
