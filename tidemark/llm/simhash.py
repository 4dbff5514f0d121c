"""SimHash near-duplicates with pivot distance tables.

Fingerprints: 64 majority bits over the XXH64 hashes of word shingles. Two
fingerprints link at a Hamming distance of `radius` or less; components of links
are the near-duplicate classes.

Links are found among distinct fingerprints only. A pivot table alone can only be
scanned, so exact blocking deals out the candidates: the 64 bits are cut into
radius + 2 blocks, and two fingerprints within the radius agree on at least two of
them, so they meet under one of the 15 pairs of blocks (radius 4). Within a block
group every fingerprint has its precomputed Hamming distances to `PIVOTS` reference
fingerprints; by the triangle inequality a pair whose largest coordinate difference
exceeds the radius is discarded, and the survivors are verified. A group keeps a
spanning forest of its links, never all pairs. Groups over `GROUP` rows are dealt
out as pairs of chunks, so that no task holds more than two chunks of a group.

With a similarity instead of a radius (`similar`), pairs link if the cosine of their
shingle sets, common shingles over the root of the product of their numbers, reaches
it: the angle whose share of a half turn is what a fingerprint's differing bits
estimate. At 0.8 one fingerprint differs in 13 bits on average and up to some 22, where
pivots tell nothing, since the distances to them spread by six bits only. So a text
has TABLES fingerprints over distinct shingles, each with hashes of its own, and a pair
survives if any of them differs in no more than 12 bits (more for the smallest sets, whose
majorities are often ties): few pairs at 0.8 have none, and the COORDINATES pivot distances
discard most pairs that differ in more. What survives in one fingerprint is verified over
the bits of all. The candidates meet under their smallest shingle hashes (a pair
whose sets share a part s of their union shares none of six with a chance of less than
(1 - s)^6, and a cosine of 0.8 means s of 0.64 or more). Fingerprints only gather
suspects, whose texts are read once more, and every link is decided on the whole sets of
64-bit shingle hashes.

Null and empty texts have no words: fingerprint zero, linked like any other. A
repeated doc_id gives a repeated row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize, release_caches, whole_texts, without
from .components import components, labels_of

RADIUS = 4
#: Keys that a text stands under for its similar ones, its fingerprints there, and the pivots of each.
ANCHORS, TABLES, COORDINATES = 6, 16, 64
#: Over the root of the smaller set's size: how much larger a share of bits differs for ties (0.064 at most, by counting).
TIES = 0.07
#: Standard deviations of the differing bits of all fingerprints within which suspects are made.
DEVIATIONS = 4.0
#: Reference fingerprints of the pivot table, drawn once from a fixed seed.
PIVOTS = 24
#: Rows of a block group that one task compares; larger groups are split into chunks of half as many.
GROUP = 4096
#: The same where rows carry many fingerprints.
SIMILAR_GROUP = 1024
#: Rows and shingles of a group of whole sets that one task compares.
SUSPECTS, SHINGLES = 1024, 1 << 22
#: Shingles hashed at a time, which bounds memory for very long texts.
SPAN = 1 << 16


def hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """Spans of the shingle hashes of one whole text, in order; nothing without words."""
    w = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space only
    n = max(1, len(w) - words + 1)
    shingles = map(b" ".join, zip(*(w[i : i + n] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    hashed = map(partial(xxhash.xxh64_intdigest, seed=42), shingles)
    for at in range(0, n if w else 0, SPAN):
        yield np.fromiter(hashed, np.uint64, min(SPAN, n - at))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes (n, ...) have each of their bits: (..., 64), counted in bytes as far as these hold."""
    bits = np.unpackbits(h[..., None].view(np.uint8), axis=-1, bitorder="little")
    full = len(h) // 255 * 255
    ones = bits[full:].sum(axis=0, dtype=np.uint8).astype(np.int64)
    return ones + bits[:full].reshape(-1, 255, *bits.shape[1:]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def majority(spans: Iterator[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in spans:
        ones += bit_counts(h)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, words: int = 4) -> int:
    """The majority bits over the shingle hashes of one whole text."""
    return majority(hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer."""

    def make():
        def run(batch):
            fps = np.array([fingerprint(t, words) for t in batch["text"]], np.uint64)
            return [batch["doc_id"], fps.view(np.int64)]

        return run

    return map_texts(whole_texts(docs), make, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 2**64, n, np.uint64)


def block_masks(radius: int) -> list[tuple[int, int]]:
    """(mask, shift-free id) of every pair of the radius + 2 blocks."""
    edges = np.linspace(0, 64, radius + 3).astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    return [(x | y, i) for i, (x, y) in enumerate(combinations(blocks, 2))]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def comparable(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """May sets of these sizes have a cosine of the similarity at all?"""
    return np.minimum(a, b) >= similarity**2 * np.maximum(a, b) - 1e-9


def within(fp: np.ndarray, radius: int):
    """Of pairs of rows of these fingerprints: those within the radius."""
    refs = pivots()
    table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)

    def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for p in range(len(refs)):
            if len(a) < 64:
                break
            own = np.abs(table[a, p] - table[b, p]) <= radius
            a, b = a[own], b[own]
        own = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        return a[own], b[own]

    return near


def suspected(columns: list[np.ndarray], similarity: float):
    """Of pairs of rows (shingles, fingerprints): those whose sets may reach the similarity."""
    size, fps = columns[0], np.frombuffer(b"".join(columns[1]), np.uint64).reshape(-1, TABLES)
    refs = pivots(COORDINATES)
    tables = [np.bitwise_count(fps[:, t, None] ^ refs).astype(np.int8) for t in range(TABLES)]
    turn = np.arccos(similarity) / np.pi

    def some(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        share = turn + TIES / np.sqrt(np.minimum(size[a], size[b]))
        radius = (64 * share).astype(int) - 1
        hit = np.zeros(len(a), bool)
        for t, table in enumerate(tables):
            at = np.nonzero(~hit)[0]
            at = at[np.abs(table[a[at]] - table[b[at]]).max(axis=1) <= radius[at]]
            hit[at] = np.bitwise_count(fps[a[at], t] ^ fps[b[at], t]) <= radius[at]
        at = np.nonzero(hit)[0]
        bits, share = 64 * TABLES, share[at]
        return at[np.bitwise_count(fps[a[at]] ^ fps[b[at]]).sum(axis=1) <= bits * share + DEVIATIONS * np.sqrt(bits * share * (1 - share))]

    def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = comparable(size[a], size[b], similarity)
        a, b = a[own], b[own]
        own = [np.zeros(0, int), *(i + some(a[i : i + 4096], b[i : i + 4096]) for i in range(0, len(a), 4096))]
        own = np.concatenate(own)
        return a[own], b[own]

    return near


def whole(columns: list[np.ndarray], similarity: float):
    """Of pairs of rows (shingles, whole set): those whose sets reach the similarity."""
    size, sets = columns[0], [np.frombuffer(x, np.uint64) for x in columns[1]]

    def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = comparable(size[a], size[b], similarity)
        for i in np.nonzero(out)[0]:
            x, y = sets[a[i]], sets[b[i]]
            common = int((x[np.searchsorted(x, y) % len(x)] == y).sum())
            out[i] = common >= similarity * np.sqrt(len(x) * len(y)) - 1e-9
        return a[out], b[out]

    return near


def linked(group: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """(row, row) of a spanning forest of the links, of pairs those that near keeps, within equal, adjacent group values."""
    rows = len(group)
    label = np.arange(rows)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count, shift = 0, 1
    at = np.arange(rows)
    while True:
        at = at[at + shift < rows]
        at = at[group[at] == group[at + shift]]
        if not len(at):
            break
        pair = at[label[at] != label[at + shift]]  # what is connected already needs no further link
        a, b = near(pair, pair + shift)
        if len(a):
            held.append((a, b))
            count += len(a)
        if held and (count > rows // 2 or shift & (shift - 1) == 0):
            a, b = (np.concatenate(x) for x in zip(*held))
            label = labels_of(rows, np.concatenate([a, np.arange(rows)]), np.concatenate([b, label]))
            held.clear()
            count = 0
        shift += 1
    if held:
        a, b = (np.concatenate(x) for x in zip(*held))
        label = labels_of(rows, np.concatenate([a, np.arange(rows)]), np.concatenate([b, label]))
    own = np.nonzero(label != np.arange(rows))[0]
    return own, label[own]


def _links(judge):
    """Links of Arrow batches (group, rep, columns), of pairs of rows those that judge(columns) keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by group; the last group of a batch waits for the next."""
        rest: list[np.ndarray] | None = None
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows)]
            whole = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            rest = [x[whole:] for x in rows]
            if whole:
                yield solve(*(x[:whole] for x in rows))
        if rest is not None and len(rest[0]):
            yield solve(*rest)

    def solve(group, rep, *columns) -> pa.RecordBatch:
        a, b = linked(group, judge(columns))
        return pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], names=["a", "b"])

    return run


def deal(tables: DataFrame, load: F.Column) -> DataFrame:
    """tables(key, fp, rep, ...) with a group for the key: keys with one row left out, those whose loads sum to over 1 as pairs of chunks."""
    sizes = tables.groupBy("key").agg(F.count("*").alias("n"), F.sum(load).alias("load")).where("n > 1")
    chunks = F.when(F.col("load") > 1, F.ceil(2 * F.col("load"))).otherwise(1).cast("int")
    return (
        tables.join(sizes.select("key", chunks.alias("chunks")), "key")
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .where("chunks = 1 OR own <> other")
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), *(c for c in tables.columns if c != "key"))
    )


def links(distinct: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """a, b: links between representatives of distinct(fp, rep), enough to span every component."""
    keyed = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(mask)))) for mask, i in block_masks(radius)]
    dealt = deal(distinct.select("rep", "fp", F.explode(F.array(*keyed)).alias("key")), F.lit(1 / group))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_links(lambda columns: within(columns[0].view(np.uint64), radius)), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    fps = materialize(fingerprints(docs, words), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = components(links(distinct.where("rep IS NOT NULL"), radius))
    classes = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingle hashes of one whole text, ascending; a text without words has the hash 0."""
    return np.unique(np.concatenate([np.unique(h) for h in hashes(text, words)] or [np.zeros(1, np.uint64)]))


def set_key(own: np.ndarray) -> int:
    """The hash of a whole set, as a signed integer."""
    return _signed(xxhash.xxh64_intdigest(own.tobytes()))


def many(own: np.ndarray) -> np.ndarray:
    """TABLES fingerprints over a set of hashes: each of other hashes, made from these by mixing."""
    odd = np.random.default_rng(77).integers(0, 2**63, TABLES, np.uint64) * np.uint64(2) + np.uint64(1)
    ones = np.zeros((TABLES, 64), np.int64)
    for i in range(0, len(own), SPAN // TABLES):
        h = own[i : i + SPAN // TABLES, None] * odd
        h ^= h >> np.uint64(32)
        h *= odd[::-1]
        h ^= h >> np.uint64(29)
        ones += bit_counts(h)
    return np.packbits(2 * ones > len(own), axis=1, bitorder="little").view(np.uint64)[:, 0]


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_key, fps (TABLES fingerprints), own (hash of the whole set), size, anchors (smallest shingle hashes)."""

    def make():
        release_caches()

        def run(batch):
            out = []
            for doc_id, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"]):
                own = shingle_set(text, words)
                out.append((doc_id, key, many(own).tobytes(), set_key(own), len(own), own[:ANCHORS].view(np.int64).tolist()))
            return list(zip(*out))

        return run

    texts = whole_texts(docs).withColumn("text_key", F.xxhash64("text"))
    return map_texts(texts, make, "doc_id long, text_key long, fps binary, own long, size long, anchors array<long>")


def whole_sets(docs: DataFrame, words: int) -> DataFrame:
    """own, size, shingles, groups: the whole sets of docs(text, node, groups) whose set is the one of that node."""

    def make():
        def run(batch):
            sets = [shingle_set(t, words) for t in batch["text"]]
            rows = [(set_key(s), len(s), s.tobytes(), g) for s, g in zip(sets, batch["groups"])]
            return [*zip(*(r for r, node in zip(rows, batch["node"]) if r[0] == node))] or [[]] * 4

        return run

    return map_texts(docs.select("text", "node", "groups"), make, "own long, size long, shingles binary, groups array<long>")


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, group: int = SIMILAR_GROUP) -> DataFrame:
    """doc_id, text_key (hash of the text), fingerprints, component_id: classes linked by shingle similarity."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(dealt: DataFrame, judge, column: str) -> DataFrame:
        grouped = dealt.select("group", "rep", "size", column).repartition(parts, "group").sortWithinPartitions("group")
        return components(grouped.mapInArrow(_links(partial(judge, similarity=similarity)), "a long, b long"))

    signed = materialize(signatures(docs, words), "signatures")
    firsts = [F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("size", "anchors"))]
    distinct = materialize(signed.groupBy("own").agg(*firsts), "distinct")
    # classes of equal sets go by the set's hash, as rows with other texts may share a doc_id
    known = distinct.where("rep IS NOT NULL").withColumnsRenamed({"rep": "least", "own": "rep"})
    # fingerprints stay where they were written, and only those of rows that share a block are shuffled
    printed = signed.select(F.col("own").alias("rep"), F.col("doc_id").alias("least"), "size", "fps")
    dealt = deal(known.select("rep", "least", F.explode("anchors").alias("key")), F.lit(1 / group))
    clusters = compare(dealt.join(printed, ["rep", "least"]), suspected, "fps")
    suspects = materialize(clusters.join(known.select(F.col("rep").alias("node"), "least", "size"), "node"), "suspects")
    # a true pair of suspects lies within one cluster; groups are dealt on narrow rows, and only then are the texts read again
    load = F.greatest(F.lit(1 / min(group, SUSPECTS)), F.col("size") / SHINGLES)
    pairs = deal(suspects.select(F.col("component").alias("key"), F.col("node").alias("rep"), "size"), load)
    groups = pairs.groupBy("rep").agg(F.collect_list("group").alias("groups"))  # as many as the cluster has chunks
    asked = suspects.join(groups, suspects["node"] == groups["rep"]).select(F.col("least").alias("_id"), "node", "groups")
    texts = whole_texts(docs).join(asked, F.col("doc_id") == F.col("_id"))
    sets = whole_sets(texts, words)  # a repeated row repeats its set, which costs a comparison
    found = compare(sets.select(F.explode("groups").alias("group"), F.col("own").alias("rep"), "size", "shingles"), whole, "shingles")
    named = found.join(suspects.select("node", "least"), "node")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = distinct.join(named.join(least, "component").select(F.col("node").alias("own"), "component_id"), "own", "left")
    return signed.join(classes.select("own", F.coalesce("component_id", "rep").alias("component_id")), "own").select(
        "doc_id", "text_key", F.lower(F.hex("fps")).alias("fingerprints"), "component_id"
    )


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs that stay, all columns untouched: of each class one with the smallest doc_id; rows without an id stay."""
    keys = materialize(similar(docs, words, similarity).where("doc_id IS NOT NULL").groupBy("component_id", "doc_id", "text_key").agg(F.count("*").alias("n")), "classes")
    firsts = keys.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.sum("n").alias("all")).where(F.col("all") > 1)
    once = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    marked = keys.join(firsts, "component_id").select("doc_id", "text_key", once.alias("once"), "n")
    gone = materialize(marked.where("NOT once OR n > 1").drop("n"), "dropped")
    # rows that share an id but not the text are told apart by the text's hash
    return without(docs, [docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"], F.lit("")))], gone)
