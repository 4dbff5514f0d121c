"""The corpus operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, langid, licenses, mixing, packing, periods, quality, simhash, token_counts, toxicity, warc, whitening
from .common import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, read back from flat files of the whole table: doc_id, n_tokens, closed, damaged."""
    path = scratch_path(spark, "tokens")
    token_counts.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_counts.count_tokens(spark, path).select("doc_id", "n_tokens", "closed", "damaged")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_level = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return quality.judge(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), byte_level, public_tokenizers.PATTERN)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of a crawl of the pages table, resolved."""
    found = warc.resolve(warc.crawl_records(table(spark, sf_dir, "pages")))
    merged = [F.try_element_at("headers", F.lit(name)).alias(name.replace("-", "_")) for name in ("date", "etag", "server", "cache-control")]
    return found.select(F.col("record_id").alias("page_id"), "canonical_url", "source_id", "verdict", *merged)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.detect(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("repetitions") * F.col("size")).alias("taken"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(whitening.quantized(table(spark, sf_dir, "embeddings")))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))  # null beyond 63 bits


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.summary(periods.periodic_runs(periods.planted(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_bpe, op2_simhash, op3_packing, op4_token_counts, op5_toxicity, op6_quality, op7_exact_dedup, op8_warc, op9_langid, op10_licenses, op11_mixing, op12_whitening, op13_periods)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
        "op8_warc": """
            WITH p AS (
                SELECT page_id, md5(coalesce(html, '')) AS digest, page_id * 60 AS ts,
                    regexp_replace(regexp_replace(trim(regexp_replace(url, '/[a-z]{2}/[0-9]+', '/' || (page_id % 3))), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
                FROM pages),
            q AS (
                SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|ref)(=|$)'))) AS kept,
                    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS place
                FROM p),
            c AS (
                SELECT *, place || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url, strftime(make_timestamp((ts - ts % 3600) * 1000000), '%Y-%m-%d %H:%M:%S') AS day,
                    ts + 30 + 60 * (page_id * 7919 % 331) AS again
                FROM q),
            s AS (
                SELECT page_id, canonical_url, ts, CASE WHEN digest[1] NOT IN ('3', '4') THEN digest END AS tag, CASE WHEN digest[3] NOT IN ('0', '1', '2') THEN day END AS made
                FROM c WHERE digest[2] NOT IN ('0', '1')),
            r AS (
                SELECT page_id, canonical_url, again, CASE digest[1] WHEN '0' THEN reverse(digest) WHEN '1' THEN NULL ELSE digest END AS tag, CASE WHEN digest[3] NOT IN ('0', '5') THEN day END AS made
                FROM c),
            j AS (
                SELECT r.*, s.page_id AS source_id, s.tag AS source_tag, s.made AS source_made
                FROM r ASOF LEFT JOIN s ON r.canonical_url = s.canonical_url AND r.again > s.ts),
            v AS (
                SELECT *, CASE WHEN source_id IS NULL THEN 'no_response' WHEN tag IS NOT NULL AND source_tag IS NOT NULL THEN CASE WHEN tag = source_tag THEN 'resolved' ELSE 'etag_mismatch' END
                    WHEN made IS NOT NULL AND source_made IS NOT NULL THEN CASE WHEN made = source_made THEN 'resolved' ELSE 'modified' END ELSE 'unvalidated' END AS verdict FROM j)
            SELECT page_id, canonical_url, source_id, verdict,
                CASE WHEN verdict = 'resolved' THEN strftime(make_timestamp(again * 1000000), '%Y-%m-%d %H:%M:%S') END AS date,
                CASE WHEN verdict = 'resolved' THEN source_tag END AS etag,
                CASE WHEN verdict = 'resolved' THEN 'origin' END AS server,
                CASE WHEN verdict = 'resolved' THEN 'max-age=3600' END AS cache_control
            FROM v""",
        "op11_mixing": """
            WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS size, md5(concat_ws(':', '11', doc_id::VARCHAR)) AS digest FROM documents),
            g AS (SELECT source, sum(size)::HUGEINT AS source_size, count(*) AS n_docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ix FROM s GROUP BY source),
            w AS (SELECT *, 3 * source_size AS cap, 1 + ix % 3 AS weight, sum(source_size) OVER () AS total, sum(1 + ix % 3) OVER () AS weights FROM g),
            o AS (
                SELECT *, total - coalesce(sum(cap) OVER before, 0) AS rest, weights - coalesce(sum(weight) OVER before, 0) AS shares FROM w
                WINDOW before AS (ORDER BY cap::DOUBLE / weight, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            l AS (SELECT max(rest) AS rest, arg_max(shares, rest) AS shares FROM (SELECT * FROM o WHERE cap * shares >= weight * rest ORDER BY cap::DOUBLE / weight, ix LIMIT 1)),
            t AS (SELECT source, source_size, n_docs, CASE WHEN cap * l.shares < weight * l.rest THEN cap::DOUBLE ELSE (weight * l.rest)::DOUBLE / l.shares::DOUBLE END AS target FROM w, l),
            r AS (
                SELECT doc_id, s.source, size, source_size::BIGINT AS source_size, target, digest, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS ratio,
                    ('0x' || substr(digest, 25, 8))::UBIGINT / 4294967296::DOUBLE AS threshold, ('0x' || substr(digest, 1, 8))::UBIGINT % greatest(1, ceil(n_docs / 1024))::UBIGINT AS bucket
                FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
            p AS (
                SELECT source, bucket, list({'doc_id': doc_id, 'size': size, 'source_size': source_size, 'target': target, 'whole': floor(ratio)::BIGINT, 'share': ratio - floor(ratio), 'threshold': threshold, 'owed': 0::DOUBLE, 'out': []::BOOLEAN[]} ORDER BY size DESC, digest) AS rows
                FROM r GROUP BY source, bucket),
            d AS (
                SELECT rows, list_reduce(list_prepend({'doc_id': NULL, 'size': 0, 'source_size': 0, 'target': 0, 'whole': 0, 'share': 0, 'threshold': 0, 'owed': 0, 'out': []::BOOLEAN[]}, rows), lambda a, x: {
                    'doc_id': x.doc_id, 'size': x.size, 'source_size': x.source_size, 'target': x.target, 'whole': x.whole, 'share': x.share, 'threshold': x.threshold,
                    'owed': CASE WHEN x.size > 0 AND a.owed + x.share * x.size > x.threshold * x.size THEN a.owed + x.share * x.size - x.size ELSE a.owed + x.share * x.size END,
                    'out': list_append(a.out, x.size > 0 AND a.owed + x.share * x.size > x.threshold * x.size)}).out AS out FROM p)
            SELECT x.doc_id, x.size, x.source_size, x.target, x.size * (x.whole + e::BIGINT) AS taken FROM (SELECT unnest(rows) AS x, unnest(out) AS e FROM d)""",
    }
