"""Periodic runs of words by a dictionary of basic factors.

A run is a maximal stretch of words with smallest period q and at least
max(MIN_WORDS, MIN_EXPONENT * q) words. Every factor whose length L is a power of two gets a
name, equal names for equal factors: a name of length 2L is the pair of its halves' names.
Two occurrences of a factor that lie within twice its length overlap, so those form
arithmetic progressions whose difference is a period. At the level with L / 2 < q <= L the
next occurrence of a factor inside a run of period q is exactly q words on (L words hold a
whole period, so by Fine and Wilf any nearer one would give the run a smaller period), and
as 4q > q + L there is more than one such position. So the stretches of positions with one
distance q propose the runs; they are extended as far as words q apart agree, and each is
taken once.

Factors that occur once in a text cannot lie on a progression, nor can what they start;
they leave the dictionary, which for prose leaves few positions after the first levels.

Only maps texts: nothing is shuffled, a text of any length is one row of work, and texts of
a batch are named together. Memory follows the words of one Arrow batch or one text. Null and
empty texts have no words, no runs and an empty collapsed text; a repeated row gives a repeated
row, a null doc_id stays null, columns other than doc_id and text are ignored, an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, release_caches, whole_texts

#: A run has this many words at least, and this many of its periods.
MIN_WORDS, MIN_EXPONENT = 6, 4
#: Words of the texts that are named together; a longer text is named alone.
BATCH_WORDS = 1 << 18

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key, name of each place of that order, whether the place before has the same name)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    return order, np.cumsum(~same) - 1, same


def _extended(words: np.ndarray, low: int, high: int, start: int, end: int, period: int) -> tuple[int, int]:
    """The stretch start..end as far as words a period apart agree within low..high."""
    while start > low and words[start - 1] == words[start - 1 + period]:
        start -= 1
    while end < high and words[end] == words[end - period]:
        end += 1
    return start, end


def find_runs(words: np.ndarray, ends: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) by start and period of the runs within each text; words holds the texts' word numbers one
    text after the other, ends where each text ends. min_exponent is 4 or more."""
    if min_exponent < 4:
        raise ValueError("a run of fewer than four periods may hold no two overlapping occurrences of a factor")
    sizes = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), sizes)
    longest = int(sizes.max(initial=0))
    at = np.nonzero(sizes[text] >= min_words)[0] if len(words) else np.zeros(0, np.int64)
    keys = text[at] * (int(words.max(initial=0)) + 1) + words[at]  # equal words of two texts have two names
    names = np.full(len(words), -1, np.int64)
    found: set[tuple[int, int, int]] = set()
    length = 1
    while len(at):
        order, named, same = _named(keys)
        placed = at[order]
        distance = np.where(same, placed - np.roll(placed, 1), 0)
        near = np.nonzero((2 * distance > length) & (distance <= length))[0]  # the occurrence before overlaps within twice the length
        if len(near):
            first, step = placed[near] - distance[near], distance[near]
            by = np.argsort(first)
            first, step = first[by], step[by]
            opens = np.nonzero(np.r_[True, (np.diff(first) != 1) | (np.diff(step) != 0)])[0]
            last = first[np.r_[opens[1:], len(first)] - 1]
            start, period = first[opens], step[opens]
            end = last + period + length
            for s, e, q in zip(start.tolist(), end.tolist(), period.tolist()):
                if e - s >= min_exponent * q:
                    high = int(ends[text[s]])
                    s, e = _extended(words, high - int(sizes[text[s]]), high, s, e, q)
                    if e - s >= min_words:
                        found.add((s, e - s, q))
        # factors that occur again go on, where the factor behind them does and ends within the text
        again = same.copy()
        again[:-1] |= same[1:]
        names[at] = -1
        names[placed[again]] = named[again]
        at = np.sort(placed[again])
        at = at[at + 2 * length <= ends[text[at]]]
        if min_exponent * length >= longest:  # the next level is for periods above length
            break
        second = names[at + length]
        at, second = at[second >= 0], second[second >= 0]
        keys = names[at] * (len(order) + 1) + second
        length *= 2
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    known: dict[bytes, int] = {}
    number = known.setdefault
    words = np.fromiter((number(w, len(known)) for t in texts for w in t), np.int64, sum(map(len, texts)))
    return words, np.cumsum([len(t) for t in texts])


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that stand in a run after its first period."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.nonzero(np.cumsum(depth[:-1]) == 0)[0].tolist()])


def _groups(sizes: list[int]):
    """Slices of neighbouring texts of together about BATCH_WORDS words."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH_WORDS:
            yield start, i
            start, total = i, 0
        total += n
    yield start, len(sizes)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period), collapsed: the text with each run cut to its first period."""

    def make():
        release_caches()

        def run(batch):
            split = [t.encode("utf-8", "surrogatepass").split() for t in batch["text"]]  # bytes: ASCII white space only
            runs, texts = [], []
            for a, b in _groups([len(w) for w in split]):
                words, ends = _numbered(split[a:b])
                found = find_runs(words, ends)
                owner = np.searchsorted(ends, found[:, 0], side="right")
                for k, w in enumerate(split[a:b]):
                    low, high = np.searchsorted(owner, [k, k + 1])
                    own = found[low:high] - [int(ends[k]) - len(w), 0, 0]
                    runs.append([tuple(r) for r in own.tolist()])
                    texts.append(collapse(w, own).decode("utf-8", "surrogatepass"))
            return [batch["doc_id"], [len(w) for w in split], runs, texts]

        return run

    return map_texts(whole_texts(docs), make, SCHEMA)


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: first start, then period; nulls without one) and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.withColumn("_best", F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.expr("(1000 * _best.length) div (-_best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: about one text in ten, by its doc_id's checksum, is made periodic from one of its words on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = whole_texts(docs).withColumn("_g", F.floor(h / 10)).withColumn("_hit", F.coalesce(h % 10 == 0, F.lit(False)))
    words = F.when(F.col("_hit"), F.regexp_extract_all("text", F.lit("[^ \\t-\\r]+"), F.lit(0)))
    rows = rows.select("doc_id", "text", "_g", words.alias("_w")).withColumn("_n", F.size("_w"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    rest = F.col("_n") - F.col("_a")
    rows = rows.withColumn("_p", (1 + F.floor(rest / (3 + F.col("_g") % 8))).cast("int"))
    cycle = F.slice(F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int"))), 1, rest)
    return rows.select("doc_id", F.when(F.col("_n") > 0, F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), cycle), " ")).otherwise(F.col("text")).alias("text"))
