"""Not-modified revisits of web archives resolved to the response they stand for.

A revisit joins, as of its time, to the latest strictly earlier full response
(status 200) of the same canonical URL. The join is a sort and a carried value:
records are range-partitioned and sorted by (URL, time), so a URL with most of all
records spreads over many partitions; within a partition the last response is
carried by a window per URL, and the last response of each partition, one row each,
is handed on to the partitions after it. Payloads stay out of the shuffles.

Validators: an entity tag on both sides must agree by weak comparison; without one on
either side, equal Last-Modified values decide; without either the revisit is
'unvalidated'. A resolved revisit gets the response's headers, overlaid by those that
a 304 answer may update.

Archives are read and written with Spark's own text source and sink: cut where version lines may begin, and put
together again by the lengths that records state.

Null URLs form no key: such revisits have 'no_response'. Null times are earliest for
responses and match nothing for revisits. Of responses with equal time the largest
record_id counts. Repeated revisits are resolved each. No records give no rows; other
columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import bound_batches, materialize

#: Headers that a 304 answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that only track.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without a trailing slash, sorted
    query parameters without tracking ones; scheme and fragment do not matter."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def first_keys(names: Column, values: Column) -> Column:
    """A map of header names, in lower case, and values; of names that clash the first counts."""
    low = F.transform(names, lambda n: F.lower(n))
    first = F.filter(F.sequence(F.lit(1), F.greatest(F.size(names), F.lit(1))), lambda i: (i <= F.size(names)) & (F.array_position(low, F.get(low, i - 1)) == i))
    return F.coalesce(F.map_from_entries(F.transform(first, lambda i: F.struct(F.get(low, i - 1), F.get(values, i - 1)))), F.create_map().cast("map<string,string>"))


def lower_keys(headers: Column) -> Column:
    return first_keys(F.map_keys(headers), F.map_values(headers))


#: Fixed value: what opens every record, whatever the version behind it; the separator at which archives are cut.
OPENS = "WARC/1."
RECORD = "record_id string, kind string, url string, date string, status int, headers map<string,string>, payload binary"


def header_fields(block: bytes) -> dict[str, str]:
    """The fields of a block of `Name: value` lines, names in lower case; of names that clash the first counts, and lines that begin with
    white space go on with the field before."""
    out: dict[str, str] = {}
    last = None
    for line in block.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and last is not None:
            out[last] = f"{out[last]} {line.decode('utf-8', 'replace').strip()}"
            continue
        name, colon, value = line.partition(b":")
        last = name.decode("utf-8", "replace").strip().lower() if colon else None
        if last is not None:
            if last in out:
                last = None
            else:
                out[last] = value.decode("utf-8", "replace").strip()
    return out


def asked_bytes(raw: bytes) -> int | None:
    """How many bytes a record asks for by its fields, which raw begins with from behind OPENS on: -1 for no stated length, None until the
    fields are whole."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    size = header_fields(raw[raw.find(b"\r\n") : end]).get("content-length", "")
    return end + 4 + int(size) if size.isdigit() else -1


def parse_record(raw: bytes, asked: int) -> tuple:
    """The columns of a whole record."""
    end = raw.find(b"\r\n\r\n")
    own, body = header_fields(raw[raw.find(b"\r\n") : end]), raw[end + 4 :]
    body = body.removesuffix(b"\r\n\r\n") if asked < 0 else raw[end + 4 : asked]
    status, headers, payload = None, {}, body
    if body.startswith(b"HTTP/"):
        http, _, payload = body.partition(b"\r\n\r\n")
        line, _, fields = http.partition(b"\r\n")
        code = line.split(b" ")[1:2]
        status, headers = int(code[0]) if code and code[0].isdigit() and len(code[0]) == 3 else None, header_fields(fields)
    kind = own.get("warc-type")
    return own.get("warc-record-id"), kind and kind.lower(), own.get("warc-target-uri"), own.get("warc-date"), status, list(headers.items()), payload


def _joined(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of pieces(file, value) in the order of their files: a record goes on over pieces until it has the length it states."""
    file, raw, asked = None, bytearray(), None
    rows: list[tuple] = []

    def done() -> None:
        if asked is not None and (row := parse_record(bytes(raw), asked))[1] is not None:
            rows.append(row)

    def taken() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows.clear()
        return out

    for batch in batches:
        for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name == file and raw and (asked is None or len(raw) < asked):
                raw += OPENS.encode() + value  # the separator stood within the record
            else:
                done()
                file, raw = name, bytearray(value)
                asked = None
            if asked is None:
                asked = asked_bytes(raw)
        if rows:
            yield taken()
    done()
    if rows:
        yield taken()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of archive files of version 1.0 or 1.1, plain or compressed, of one or many members: record_id, kind, url, ts (seconds),
    status, etag, last_modified, headers, payload (bytes).

    Spark cuts files where a version line may begin, so that plain files are read by many tasks; the pieces of a file then meet in order, and
    a record goes on over as many of them as its Content-Length asks for, so a payload may hold version lines. A record
    without a length ends at the next version line, one that is cut off keeps what there is, one without a type is none."""
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = spark.read.option("lineSep", OPENS).text(path)
    pieces = cut.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    ordered = pieces.repartition(parts, "file").sortWithinPartitions("file", "block", "at").select("file", "value")
    return ordered.mapInArrow(functools.partial(_joined, to_arrow_schema(StructType.fromDDL(RECORD))), RECORD).select(
        "record_id",
        "kind",
        "url",
        F.unix_seconds(F.try_to_timestamp("date")).alias("ts"),
        "status",
        F.try_element_at("headers", F.lit("etag")).alias("etag"),
        F.try_element_at("headers", F.lit("last-modified")).alias("last_modified"),
        "headers",
        "payload",
    )


def write_records(records: DataFrame, path: str, version: str = "1.1") -> None:
    """Write records(record_id, kind, url, ts, status, headers, payload) as archive files; null fields are left out, payloads are text or bytes."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    headers = F.array_join(F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")), F.lit("\r\n"))), "")
    head = F.concat(F.lit("HTTP/1.1 "), F.coalesce(F.col("status").cast("string"), F.lit("200")), F.lit("\r\n"), headers, F.lit("\r\n"))
    body = F.concat(head.cast("binary"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    date = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = [("WARC-Type", F.col("kind")), ("WARC-Record-ID", F.col("record_id").cast("string")), ("WARC-Target-URI", F.col("url")), ("WARC-Date", date), ("Content-Length", F.octet_length(body).cast("string"))]
    top = F.concat_ws("", F.lit(f"WARC/{version}\r\n"), *(line(n, v) for n, v in fields), F.lit("\r\n"))
    records.select(F.concat(top.cast("binary"), body).cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit of records(record_id, kind, url, ts, status, etag, last_modified, headers):
    record_id, canonical_url, source_id, verdict, headers (null unless resolved)."""
    spark = records.sparkSession
    response = (F.col("kind") == "response") & (F.col("status") == 200)
    rows = records.where(response | (F.col("kind") == "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", F.coalesce(response, F.lit(False)).alias("full"), "etag", "last_modified", "headers"
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # at equal times revisits stand before responses: only earlier ones count
    order = ["canonical_url", "ts", "full", "record_id"]
    dealt = materialize(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "records")
    own = F.when(F.col("full"), F.struct("canonical_url", "record_id", "ts", "etag", "last_modified", "headers"))
    # the last response of each partition: one row for each, handed to all later partitions
    tails = dealt.where("full AND canonical_url IS NOT NULL").groupBy("part").agg(F.max_by(own, F.struct(*order)).alias("tail"))
    carried = F.last("tail", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    handed = spark.range(parts).select(F.col("id").cast("int").alias("part")).join(tails, "part", "left").select("part", carried.alias("handed"))
    last = F.last(own, ignorenulls=True).over(Window.partitionBy("part", "canonical_url").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1))
    found = dealt.withColumn("here", last).where(~F.col("full")).join(F.broadcast(handed), "part", "left")
    source = F.coalesce("here", F.when(F.col("handed.canonical_url") == F.col("canonical_url"), F.col("handed")))
    source = F.when(F.col("canonical_url").isNotNull() & F.col("ts").isNotNull(), source)
    found = found.withColumn("source", source)
    tag = lambda c: F.regexp_replace(F.trim(c), "^W/", "")
    verdict = (
        F.when(F.col("source").isNull(), "no_response")
        .when(F.col("etag").isNotNull() & F.col("source.etag").isNotNull(), F.when(tag(F.col("etag")) == tag(F.col("source.etag")), "resolved").otherwise("etag_mismatch"))
        .when(F.col("last_modified").isNotNull() & F.col("source.last_modified").isNotNull(), F.when(F.col("last_modified") == F.col("source.last_modified"), "resolved").otherwise("modified"))
        .otherwise("unvalidated")
    )
    update = F.map_filter(lower_keys(F.col("headers")), lambda k, _: k.isin(*PERMITTED))
    base = lower_keys(F.col("source.headers"))
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(update), k))
    return found.withColumn("verdict", verdict).select("record_id", "canonical_url", F.col("source.record_id").alias("source_id"), "verdict", F.when(F.col("verdict") == "resolved", F.map_concat(kept, update)).alias("headers"))


def crawl_records(pages: DataFrame) -> DataFrame:
    """Archive records of a crawl of pages(page_id, url, html) that comes back to few URLs.

    The pages of a site share three paths. Each is a response one minute after the page before, some of them errors, some
    without a tag or a date, and a revisit up to some five hours later, so that responses of its URL lie before and after it. The
    revisit's validators are those of its own page, some reversed, weak or missing. Null html counts as empty; a null page_id
    or url gives records without a URL, hence without a response; repeated pages give repeated records.
    """
    body = F.coalesce("html", F.lit(""))
    own = pages.select(
        F.col("page_id").cast("long").alias("record_id"),
        F.regexp_replace("url", F.lit("/[a-z]{2}/[0-9]+"), F.concat(F.lit("/"), (F.col("page_id") % 3).cast("string"))).alias("url"),
        (F.col("page_id").cast("long") * 60).alias("ts"),
        F.md5(body.cast("binary")).alias("digest"),
    )
    stamp = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss")
    digit = lambda i: F.substring("digest", i, 1)
    made = stamp(F.col("ts") - F.col("ts") % 3600)
    tag = F.when(~digit(1).isin("3", "4"), F.col("digest"))
    dated = F.when(~digit(3).isin("0", "1", "2"), made)
    no_tag = F.map_filter(F.create_map(F.lit("ETag"), tag), lambda _, v: v.isNotNull())
    response = F.struct(
        F.lit("response").alias("kind"), F.col("ts").alias("ts"), F.when(digit(2).isin("0", "1"), 404).otherwise(200).alias("status"), tag.alias("etag"), dated.alias("last_modified"),
        F.map_concat(F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), stamp(F.col("ts")), F.lit("Server"), F.lit("origin"), F.lit("Cache-Control"), F.lit("max-age=60")), no_tag).alias("headers"),
    )
    again = F.col("ts") + 30 + 60 * (F.col("record_id") * 7919 % 331)
    asked = F.when(digit(1) == "0", F.reverse("digest")).when(digit(1) == "1", F.lit(None)).when(digit(1) == "2", F.concat(F.lit("W/"), "digest")).otherwise(F.col("digest"))
    revisit = F.struct(
        F.lit("revisit").alias("kind"), again.alias("ts"), F.lit(304).alias("status"), asked.alias("etag"), F.when(~digit(3).isin("0", "5"), made).alias("last_modified"),
        F.create_map(F.lit("date"), stamp(again), F.lit("server"), F.lit("edge"), F.lit("cache-control"), F.lit("max-age=3600"), F.lit("content-length"), F.lit("0")).alias("headers"),
    )
    return own.select("record_id", "url", F.explode(F.array(response, revisit)).alias("r")).select("record_id", "url", "r.*")
