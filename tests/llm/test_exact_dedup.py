import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F
from tidemark.llm import exact_dedup


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(text or "", []).append(i)
    out = []
    for i, text in rows:
        ids = groups[text or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    r = random.Random(4)
    texts = [f"text {k}" for k in range(150)] + ["Ü ", "Ü ", "big " * 50000]
    rows = [(i, r.choice(["hot"] * 150 + [None, ""] * 10 + texts)) for i in range(900)] + [(None, "only nulls"), (None, "text 1"), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, group_size int")
    for counters in (1, 3, 256):  # few counters: most groups go the ordinary way
        got = sorted((tuple(x) for x in exact_dedup.exact_dedup(df.repartition(5), counters).collect()), key=str)
        assert got == brute(rows)
    kept = exact_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.where("doc_id IS NOT NULL").collect()) == sorted({i for i, k, _, own, _ in brute(rows) if own and i is not None})
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_summary_finds_every_heavy_digest(spark):
    r = random.Random(9)
    values = ["a"] * 400 + ["b"] * 200 + [f"x{i}" for i in range(600)]
    r.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v string").select(F.col("v").cast("binary").alias("digest")).repartition(40)
    found = {bytes(x.digest).decode(): x.n for x in exact_dedup.heavy_candidates(df, 7).collect()}
    assert len(found) <= 7 and {"a", "b"} <= set(found)
    assert all(found[v] <= n for v, n in Counter(values).items() if v in found)


def test_keep_one_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a", "x"), (1, "a", "w"), (2, "b", None), (None, "c", "n"), (None, "c", "m"), (3, "b", "y"), (3, None, "z"), (3, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, once string").repartition(4)
    kept = sorted((str(r.doc_id), r.text or "", r.once) for r in exact_dedup.keep_one(df).collect())
    assert kept == [("1", "a", "w"), ("3", "", "z"), ("3", "b", "y"), ("None", "c", "m")]
