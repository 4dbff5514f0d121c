"""Language identification by nearest centroids.

A text becomes a vector of hashed character 1- to 3-gram counts over its letters,
damped, weighted by inverse document frequency and normalised. Each language has
several centroids, found by spherical k-means; the nearest by cosine names the
language. A text whose nearest centroid is farther than its language's learned
reach is rejected.

Learning: document frequencies and language counts cover every learning row (text
and lang not null, crc32 of the id mod 4 not 2). Every language is fitted, on an
executor, on the SAMPLE rows with the smallest hashes of id and text. Centroids reach
the tasks in blocks of BLOCK languages; with more, a text takes the best of all blocks.

Texts that are null or have no letter: lang_pred 'und', score 0, rejected. Long texts
count whole. Without any learning row every text is 'und'. Repeated rows are judged
each; an empty table gives an empty result. lang, source and doc_id are not inputs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import held_out, map_texts, materialize, unused

BINS = 4096
#: Rows per language that the centroids are fitted on, at most.
SAMPLE = 400
#: Languages whose centroids a task holds at a time.
BLOCK = 2000
CENTROIDS = 4
#: Code points turned into grams at a time, which bounds memory for very long texts.
SPAN = 1 << 20
#: A text is rejected if its cosine is under this share of the lowest in its language's sample but for 1 in 200. With any one of
#: four languages of one script left out of the fit, 0.7 rejects over 96 % of its texts and under 0.1 % of the others; 0.5 may reject 5 %.
REACH = 0.7
#: Grams of a text from which the whole reach holds; a cosine with few grams grows as the root of their number.
LONG = 600


@functools.cache
def letters() -> np.ndarray:
    """Of each code point: its lower-case self if a letter, else 0."""
    return np.array([ord(chr(c).lower()[0]) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def gram_counts(text: str) -> np.ndarray | None:
    """Hashed counts of 1- to 3-grams within words, word ends included; None without letters."""
    total = np.zeros(BINS, np.int64)
    table = letters()
    for at in range(0, len(text), SPAN):
        codes = table[np.frombuffer(text[max(0, at - 2) : at + SPAN].encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes = np.concatenate([codes[:0] if at else np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32) if at + SPAN >= len(text) else codes[:0]])
        if not codes.any():
            continue
        one = codes * np.uint32(2654435761)
        two = (one[:-1] ^ (codes[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        three = (two[:-1] ^ (codes[2:] * np.uint32(668265263))) * np.uint32(374761393)
        keep2, keep3 = (codes[:-1] != 0) | (codes[1:] != 0), codes[1:-1] != 0  # not across words
        fresh = 2 if at else 0  # the overlap's own 1-grams and 2-grams were counted before
        for h in (one[fresh:][codes[fresh:] != 0], two[max(0, fresh - 1) :][keep2[max(0, fresh - 1) :]], three[keep3]):
            total += np.bincount(h >> np.uint32(20), minlength=BINS)
    return total if total.any() else None


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(normalised TF-IDF rows, how many grams each has; 0 without letters)."""
    out, grams = np.zeros((len(texts), BINS), np.float32), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        counts = gram_counts(text) if text else None
        if counts is not None:
            row = np.log1p(counts) * idf
            out[i], grams[i] = row / (np.linalg.norm(row) or 1), counts.sum()
    return out, grams


def cluster(rows: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """Spherical k-means centroids of normalised rows, farthest-first start."""
    own = np.random.default_rng(seed)
    centres = [rows[own.integers(len(rows))]]
    for _ in range(min(k, len(rows)) - 1):
        centres.append(rows[np.argmin(np.max(rows @ np.array(centres).T, axis=1))])
    c = np.array(centres)
    for _ in range(12):
        near = np.argmax(rows @ c.T, axis=1)
        for j in range(len(c)):
            if (near == j).any():
                mean = rows[near == j].mean(axis=0)
                c[j] = mean / (np.linalg.norm(mean) or 1)
    return c


class Model:
    """A block of languages with their centroids and reaches."""

    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, of: np.ndarray, reach: np.ndarray):
        self.languages, self.idf, self.centroids, self.of, self.reach = languages, idf, centroids, of, reach

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or 'und', cosine to its nearest centroid, least cosine that is not rejected)."""
        rows, grams = vectors(texts, self.idf)
        ok = grams > 0
        if not len(self.centroids):
            return ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.inf)
        cosine = rows @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(float)
        lang = self.of[best]
        least = np.where(ok, self.reach[lang] * np.sqrt(np.minimum(1, grams / LONG)), np.inf)
        return [self.languages[x] if y else "und" for x, y in zip(lang, ok)], np.where(ok, score, 0.0), least


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Iterator[Model]:
    """Learn from the rows of docs(doc_id, text, lang) that are not held out; one block at least."""
    rows = docs.select(F.col("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("hash"))

    def make():
        def run(batch):
            """Bins with the texts that have them, and all texts at bin -1; the hash of each text with letters under its language."""
            df, lettered = np.zeros(BINS, np.int64), []
            for lang, text, key in zip(batch["lang"], batch["text"], batch["hash"]):
                counts = gram_counts(text)
                if counts is not None:
                    df += counts > 0
                    lettered.append((lang, None, 1, key))
            at = np.nonzero(df)[0]
            return list(zip(*lettered, *((None, b, n, None) for b, n in zip(at.tolist(), df[at].tolist())), (None, -1, len(lettered), None)))

        return run

    found = map_texts(rows, make, "lang string, bin int, n long, hash long")
    counted = materialize(found.groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.approx_count_distinct("hash").alias("texts")), "grams")
    df, n = np.zeros(BINS), 0
    for r in counted.where("bin IS NOT NULL").select("bin", "n").collect():  # BINS + 1 rows at most
        if r["bin"] < 0:
            n = r["n"]
        else:
            df[r["bin"]] = r["n"]
    idf = np.log((1 + n) / (1 + df)) + 1
    # thinned to some three samples a language first, so that no task ranks a whole language
    share = F.least(F.lit(1.0), F.lit(3.0 * sample) / F.col("texts"))
    sizes = counted.where("bin IS NULL").select("lang", share.alias("share"))
    thin = rows.join(sizes, "lang").where(F.pmod(F.xxhash64("hash", F.lit("sample")), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "text", "hash")

    def make_rows():
        def run(batch):
            out, grams = vectors(batch["text"], idf)
            ok = np.nonzero(grams > 0)[0]
            return [[batch["lang"][i] for i in ok], [batch["hash"][i] for i in ok], [out[i].astype(np.float16).tobytes() for i in ok]]

        return run

    def fit_one(table: pa.Table) -> pa.Table:
        own = np.array([np.frombuffer(b, np.float16) for b in sorted(table.column("row").to_pylist())], np.float32)
        centres = cluster(own, centroids)
        reach = REACH * np.quantile((own @ centres.T).max(axis=1), 0.005)
        return pa.table({"lang": pa.array(table.column("lang").to_pylist()[:1], pa.string()), "reach": pa.array([float(reach)]), "centres": pa.array([centres.astype(np.float32).tobytes()], pa.binary())})

    drawn = map_texts(thin.dropDuplicates(["lang", "hash"]), make_rows, "lang string, hash long, row binary")
    first = drawn.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("at") <= sample)
    learned = materialize(first.select("lang", "row").groupBy("lang").applyInArrow(fit_one, "lang string, reach double, centres binary"), "centroids")
    fitted = learned.orderBy("lang").toLocalIterator()
    made = False
    while (block := [r for _, r in zip(range(BLOCK), fitted)]) or not made:
        made = True
        centres = [np.frombuffer(r["centres"], np.float32).reshape(-1, BINS) for r in block]
        of = np.repeat(np.arange(len(block)), [len(c) for c in centres])
        yield Model([r["lang"] for r in block], idf, np.concatenate(centres) if block else np.zeros((0, BINS), np.float32), of, np.array([r["reach"] for r in block]))


def judged(docs: DataFrame, models: Iterator[Model]) -> tuple[DataFrame, str, str, str]:
    """docs with three more columns, and their names, which docs does not have: the language, score and least score of the best over all blocks."""
    named, scored, least_of = (unused(docs, n) for n in ("lang_pred_", "score_", "least_"))
    out = docs.withColumns({named: F.lit("und"), scored: F.lit(-1.0), least_of: F.lit(0.0)})
    schema = StructType([*docs.schema.fields, StructField(named, StringType()), StructField(scored, DoubleType()), StructField(least_of, DoubleType())])
    for at, model in enumerate(models):
        if at:
            out = materialize(out, "judged")  # one block of centroids in a task
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def make(shared=shared):
            def run(batch):
                lang, score, least = shared.value.judge(batch["text"])
                better = score > np.array(batch[scored])
                batch[named] = [x if y else z for x, y, z in zip(lang, better, batch[named])]
                batch[least_of] = np.where(better, least, np.array(batch[least_of]))
                batch[scored] = np.where(better, score, np.array(batch[scored]))
                return [batch[f.name] for f in schema.fields]

            return run

        out = map_texts(out, make, schema)
    return out, named, scored, least_of


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: fit on the learning rows, judge all."""
    known = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    rows, named, scored, least = judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(known))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(named).alias("lang_pred"), F.col(scored).alias("score"), (F.col(scored) < F.col(least)).alias("rejected"))


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, all columns; a null lang takes the prediction. Without a lang
    column nothing is learned, so no text has a known language."""
    known = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    rows, named, scored, least = judged(docs, fit(known))
    return rows.where(F.col(scored) >= F.col(least)).select(*(F.coalesce("lang", named).alias("lang") if n == "lang" else F.col(f"`{n}`") for n in docs.columns))
