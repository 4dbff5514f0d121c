"""Indexing a folder: files to chunks, chunks to the next version of a table."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..session import settle
from ..sources import files, tables


Reader = Callable[[bytes], list[str]]


def _chunked(spark: SparkSession, path: str, read_pdf: Reader | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, files that were read, failures) of a folder; every file is read once."""
    docs, failures = files.scan_directory(spark, path)
    docs = settle(docs.select("source_path", "text"), "documents")
    done, pages = docs.select("source_path"), None
    if read_pdf is not None:
        pages, unread = files.read_pages(spark, path, read_pdf)
        failures = failures.unionByName(unread)
        done = done.unionByName(pages.select("source_path").distinct())
    return settle(chunking.split_documents(docs, pages), "chunks"), done, failures


def index_directory(spark: SparkSession, path: str, root: str, read_pdf: Reader | None = None) -> DataFrame:
    """Chunk the .txt, .md and, with read_pdf, .pdf files directly in a folder and publish them as the table at root, where
    they replace their files' earlier chunks: one row of counters. A file that cannot be read fails alone and keeps its
    earlier chunks; one that became blank loses them."""
    started = F.lit(datetime.datetime.now(datetime.timezone.utc))
    chunks, done, failures = _chunked(spark, path, read_pdf)
    if tables.current_version(spark, root):
        others = tables.read(spark, root).join(done, "source_path", "left_anti")
        tables.publish(others.select(chunks.columns).unionByName(chunks), root)
    else:
        tables.publish(chunks, root)
    return files.job_counters(done, failures, started)


def rebuild_directory(spark: SparkSession, path: str, root: str, backup: str, read_pdf: Reader | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunk all files of a folder anew in place of the table at root, whose rows go to backup: (one row: table, backup, n_rows, and the
    counters; a row for each distinct file in order: source_path, n_chunks, error)."""
    started = F.lit(datetime.datetime.now(datetime.timezone.utc))
    chunks, done, failures = _chunked(spark, path, read_pdf)
    summary = tables.rebuild(spark, root, chunks, backup)
    sizes = chunks.groupBy("source_path").agg(F.count("*").alias("n_chunks"))
    each = files.files_to_index(spark, path).join(sizes, "source_path", "left").join(failures, "source_path", "left")
    each = each.select("source_path", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "error").orderBy("source_path")
    return summary.join(F.broadcast(files.job_counters(done, failures, started))), each  # one row each
