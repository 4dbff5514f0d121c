"""Token counts from flat, unindexed token files by a separator scan.

A token file is nothing but big-endian unsigned 16-bit ids: every document is opened by
`header` ids that hold its number, 15 bits each (none, if header is 0), and closed by an
end-of-document id. A file becomes rows of one byte range, a block, each. A block is
searched for separators with one vectorised comparison and reduced to its closed documents
and to the one left open at its end. A prefix scan over the blocks of a file then joins
what is open at a block's end to the first separator of a later block, so a document may
span any number of blocks. Blocks overlap by a header, so a number is never cut. Tokens
after the last separator count as an unclosed document, an odd last byte as damage.

The writer makes such files from texts: rows of whole documents with separators between
them, the separator again as the text sink's line end, so any store that Spark writes to
will do. The default separator is free in vocabularies up to 50,304 ids and, in this byte
order, the UTF-8 form of one character, which the sink's line end has to be. Files are
bounded: FILE_ROWS rows of ROW_BYTES, or of one document if that is longer.

Null and empty texts are documents without tokens; a null doc_id comes back null. Repeated
rows are documents of their own. No files or empty files give no rows. Other columns of
the documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_texts, materialize, whole_texts
from .token_bytes import token_bytes

#: The separator: bytes C4 80, U+0100.
SEPARATOR = 0xC480
#: Ids of a document's number: five of 15 bits hold 64 bits and the mark of a null.
HEADER = 5
#: Ids of a block; bytes of a row that the writer fills up; rows of a file.
BLOCK = 1 << 16
ROW_BYTES, FILE_ROWS = 1 << 20, 48


def header_of(doc_id: int | None) -> bytes:
    number = (16 << 60) if doc_id is None else doc_id % (1 << 64)
    return b"".join((number >> shift & 0x7FFF).to_bytes(2, "big") for shift in range(60, -1, -15))


def numbers_of(headers: np.ndarray) -> list[int | None]:
    """doc_ids of rows of HEADER ids."""
    digits = headers.astype(np.uint64)
    low = sum((digits[:, i] << np.uint64(shift) for i, shift in enumerate(range(60, -1, -15))), np.zeros(len(digits), np.uint64))
    return [None if mark >= 16 else n for mark, n in zip(digits[:, 0].tolist(), low.view(np.int64).tolist())]


def write_tokens(docs: DataFrame, vocabulary: str, path: str, separator: int = SEPARATOR) -> None:
    """Encode every whole text and write flat token files, each document with its number, to path."""
    end = separator.to_bytes(2, "big")
    line_end = end.decode("utf-8")  # raises if the sink cannot write it

    def make():
        encode = token_bytes(vocabulary, ">u2")

        def run(batch):
            rows, held, size = [], [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                own = header_of(doc_id) + encode(text)
                if held and size + len(own) > ROW_BYTES:
                    rows.append(end.join(held))
                    held, size = [], 0
                held.append(own)
                size += len(own)
            return [[*rows, end.join(held)]]

        return run

    ids = map_texts(whole_texts(docs), make, "ids binary")
    ids.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", line_end).option("maxRecordsPerFile", FILE_ROWS).text(path)


_OPEN = pa.struct([("start", pa.int64()), ("doc_id", pa.int64())])
_INNER = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64())])
_BLOCKS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("lead", _OPEN), ("opened", _OPEN), ("first_end", pa.int64()), ("n_ends", pa.int64()), ("inner", pa.list_(_INNER)), ("file_tokens", pa.int64()), ("damaged", pa.bool_())])
_BLOCKS_DDL = (
    "file string, block long, lead struct<start:long,doc_id:long>, opened struct<start:long,doc_id:long>, first_end long, n_ends long, "
    "inner array<struct<start:long,length:long,doc_id:long>>, file_tokens long, damaged boolean"
)


def scan_blocks(spark: SparkSession, path: str, separator: int = SEPARATOR, block: int = BLOCK, header: int = HEADER) -> DataFrame:
    """One row per byte range of each file in path, whatever its name: file, block, lead (the file's first document, in its first block), opened (the
    document left open at the block's end, if it began there), first_end (offset of the first separator), n_ends,
    inner (documents that begin after a separator of the block and end in it), file_tokens, damaged."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    count = F.greatest(F.lit(1), F.ceil(F.col("length") / (2 * block))).cast("int")
    own = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("content"), i * (2 * block) + 1, F.lit(2 * (block + header))))
    ranges = files.select(F.col("path").alias("file"), "length", F.posexplode(own).alias("block", "bytes"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                name, length, at = (batch.column(c)[i].as_py() for c in ("file", "length", "block"))
                raw = batch.column("bytes")[i].as_buffer()
                ids = np.frombuffer(raw, ">u2", len(raw) // 2)
                first = at * block
                ends = np.nonzero(ids[:block] == separator)[0]
                starts = np.concatenate([[0], ends + 1]) if at == 0 else ends + 1
                numbers: list[int | None] = [None] * len(starts)
                if header and len(starts):
                    places = starts[:, None] + np.arange(header)
                    cut = (places[:, -1] >= len(ids)).tolist()  # the file ends within the number
                    numbers = [None if x else n for n, x in zip(numbers_of(ids[np.minimum(places, max(0, len(ids) - 1))]) if len(ids) else numbers, cut)]
                begun = [{"start": first + int(s), "doc_id": n} for s, n in zip(starts, numbers)]
                lead = begun.pop(0) if at == 0 else None
                inner = [b | {"length": first + int(e) - b["start"]} for b, e in zip(begun, ends[1:])]
                rows.append(
                    {"file": name, "block": at, "lead": lead, "opened": begun[-1] if begun else None, "first_end": first + int(ends[0]) if len(ends) else None, "n_ends": len(ends), "inner": inner, "file_tokens": length // 2, "damaged": bool(length % 2)}
                )
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _BLOCKS)

    return ranges.mapInArrow(scan, _BLOCKS_DDL)


def count_tokens(spark: SparkSession, path: str, separator: int = SEPARATOR, block: int = BLOCK, header: int = HEADER) -> DataFrame:
    """file, document (from 0 within its file), doc_id, start (its offset there), n_tokens, closed, damaged."""
    blocks = materialize(scan_blocks(spark, path, separator, block, header), "blocks")
    # the prefix scan: a file has few blocks, as files are bounded
    ordered = Window.partitionBy("file").orderBy("block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    lead = F.first("lead", ignorenulls=True).over(Window.partitionBy("file"))
    stitched = (
        blocks.withColumn("open", F.coalesce(F.last("opened", ignorenulls=True).over(before), lead))
        .withColumn("document", F.coalesce(F.sum("n_ends").over(before), F.lit(0).cast("long")))
        .withColumn("last", F.lead("block").over(ordered).isNull())
    )
    tokens = lambda length: F.greatest(F.lit(0).cast("long"), length - header).alias("n_tokens")
    whole, no = F.lit(True).alias("closed"), F.lit(False).alias("damaged")
    first = stitched.where("n_ends > 0").select("file", "document", "open.doc_id", "open.start", tokens(F.col("first_end") - F.col("open.start")), whole, no)
    inner = stitched.where("n_ends > 1").select("file", "document", F.posexplode("inner").alias("i", "x"))
    inner = inner.select("file", (F.col("document") + 1 + F.col("i")).alias("document"), "x.doc_id", "x.start", tokens(F.col("x.length")), whole, no)
    rest = F.coalesce("opened", "open")
    left = stitched.withColumn("open", rest).where(F.col("last") & ((F.col("file_tokens") > F.col("open.start")) | F.col("damaged")))
    left = left.select("file", (F.col("document") + F.col("n_ends")).alias("document"), "open.doc_id", "open.start", tokens(F.col("file_tokens") - F.col("open.start")), F.lit(False).alias("closed"), "damaged")
    return first.unionByName(inner).unionByName(left)
