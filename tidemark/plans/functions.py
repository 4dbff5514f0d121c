"""Table functions that SQL users call with arguments, alone or laterally for each row of another table.

They are SQL functions of the session, so their bodies are planned with the query around them: filters on topic and
time reach the scan, and of the rows of a search no task keeps more than are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import TOKEN
from ..operators import bm25, ops


def _view(df: DataFrame, name: str) -> str:
    df.createOrReplaceTempView(name)
    return name


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_time(spark: SparkSession) -> None:
    """now_text([zone]): the present time as text; now_ms(): as milliseconds."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION now_text(zone STRING DEFAULT 'Asia/Shanghai') RETURNS STRING RETURN date_format(convert_timezone(current_timezone(), zone, localtimestamp()), 'yyyy-MM-dd HH:mm:ss')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION now_ms() RETURNS BIGINT RETURN unix_millis(current_timestamp())")


def register_logs(logs: DataFrame, name: str = "search_log") -> None:
    """name(topic, start_ms, end_ms[, max_rows]): the oldest lines of logs(event_id, ts, topic, level, message) of a topic, null for all topics, within
    a span of time, both ends included."""
    spark, view = logs.sparkSession, _view(logs, f"{name}_lines")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(wanted STRING, start_ms BIGINT, end_ms BIGINT, max_rows INT DEFAULT 100)
        RETURNS TABLE(event_id BIGINT, ts TIMESTAMP, topic STRING, level STRING, message STRING)
        RETURN SELECT event_id, ts, topic, level, message FROM (
            SELECT event_id, ts, topic, level, message, row_number() OVER (ORDER BY ts, event_id) AS n FROM {view}
            WHERE (wanted IS NULL OR topic = wanted) AND ts BETWEEN timestamp_millis(start_ms) AND timestamp_millis(end_ms))
        WHERE n <= max_rows""")


def register_metrics(points: DataFrame, name: str = "metric_report", settings: Settings = DEFAULTS) -> None:
    """name(metric, service, start_ms, end_ms): statistics and alert of the points(service, metric, ts, value) of a service within a span of
    time; metric is cpu or memory, which have their own thresholds. The 95th percentile is the sorted value at n * 0.95, counted
    over the span's distinct values."""
    spark, view = points.sparkSession, _view(points, f"{name}_points")
    cpu, memory = (tuple(map(_text, m)) for m in (ops.CPU_MESSAGES, ops.MEMORY_MESSAGES))
    limit = f"CASE wanted WHEN 'memory' THEN {settings.memory_alert}D ELSE {settings.cpu_alert}D END"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(wanted STRING, asked STRING, start_ms BIGINT, end_ms BIGINT)
        RETURNS TABLE(n BIGINT, average DOUBLE, highest DOUBLE, lowest DOUBLE, p95 DOUBLE, threshold DOUBLE, triggered BOOLEAN, message STRING)
        RETURN SELECT n, average, highest, lowest, p95, {limit}, highest > {limit},
            CASE WHEN wanted = 'memory' THEN if(highest > {limit}, {memory[0]}, {memory[1]}) ELSE if(highest > {limit}, {cpu[0]}, {cpu[1]}) END
        FROM (
            SELECT coalesce(sum(c), 0) AS n, round(sum(value * c) / sum(c), 2) AS average, max(value) AS highest, min(value) AS lowest, round(min(CASE WHEN upto > least(floor(total * 0.95D), total - 1) THEN value END), 2) AS p95
            FROM (SELECT value, c, sum(c) OVER (ORDER BY value) AS upto, sum(c) OVER () AS total FROM (
                SELECT value, count(*) AS c FROM {view} WHERE metric = wanted AND service = asked AND value IS NOT NULL AND ts BETWEEN timestamp_millis(start_ms) AND timestamp_millis(end_ms) GROUP BY value)))""")


def register_search(index: bm25.Index, docs: DataFrame, name: str = "search_knowledge", settings: Settings = DEFAULTS) -> None:
    """name(question[, max_rows]): the best documents of docs(doc_id, text, source) for a question by BM25 over their keyword index."""
    spark = docs.sparkSession
    postings, frequencies, texts = _view(index.postings, f"{name}_postings"), _view(index.frequencies, f"{name}_frequencies"), _view(docs.select("doc_id", "text", "source"), f"{name}_texts")
    k1, b, average = settings.bm25_k1, settings.bm25_b, max(index.avg_len, 1.0)
    part = f"q.n * ln(1 + ({index.n_docs} - f.df + 0.5D) / (f.df + 0.5D)) * (p.tf * {k1 + 1}D) / greatest(p.tf + {k1}D * ({1 - b}D + {b}D * p.dl / {average!r}D), 1e-9D)"
    bucket = f"AND p.bucket = pmod(xxhash64(q.token), {bm25.BUCKETS})" if "bucket" in index.postings.columns else ""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(question STRING, max_rows INT DEFAULT {settings.final_k})
        RETURNS TABLE(place INT, doc_id BIGINT, score DOUBLE, source STRING, text STRING)
        RETURN SELECT place, r.doc_id, score, source, text FROM (
            SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM (
                SELECT p.doc_id, round(sum({part}), 9) AS score
                FROM (SELECT token, count(*) AS n FROM explode(regexp_extract_all(lower(question), {_text(TOKEN)}, 0)) AS t(token) GROUP BY token) q
                JOIN {frequencies} f ON f.token = q.token JOIN {postings} p ON p.token = q.token {bucket} GROUP BY p.doc_id)
            WHERE score > 0) r
        JOIN {texts} d ON d.doc_id = r.doc_id WHERE place <= max_rows""")


def from_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(logs, points) of events(event_id, ts, event_type, value, props), for the two functions: errors have the level ERROR; every value is
    a point of both metrics of its event type."""
    ts = F.col("ts").cast("timestamp").alias("ts")
    logs = events.select("event_id", ts, F.col("event_type").alias("topic"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.col("props").alias("message"))
    points = events.select(F.col("event_type").alias("service"), F.explode(F.array(F.lit("cpu"), F.lit("memory"))).alias("metric"), ts, "value")
    return logs, points
