import random

import corpus_pipeline
from pyspark.sql import functions as F
from tidemark.llm.common import materialize

PARTS = {"aa": ["the", "ing", "tion", "er", "wh"], "bb": ["cion", "ado", "n", "que", "os"]}


def fixture(n=300):
    r = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        lang = r.choice(list(PARTS))
        w = ["".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(80, 160))]
        toxic = i % 5 == 0
        if toxic:
            for word in r.sample(["fool", "jerk", "nitwit"], 2):
                w.insert(r.randrange(len(w)), word)
        docs.append((i, " ".join(w), lang, f"src{i % 3}", 0, 1))
        labels.append((i, 1, int(toxic)))
    clean = [d for d in docs if d[0] % 5]
    for k, d in enumerate(clean[:20]):  # exact copies, and near copies with one word changed
        docs.append((1000 + k, d[1], d[2], "copy", 0, 1))
        w = d[1].split()
        w[3] = "changed"
        docs.append((2000 + k, " ".join(w), None, "near", 0, 1))
    docs += [(3000, None, "aa", "s", 0, 1), (3001, "", "aa", "s", 0, 1), (3002, "123 ###", None, "s", 0, 1)]
    lone = " ".join("".join(r.choice(PARTS["aa"]) for _ in range(3)) for _ in range(100))
    docs += [(3003, lone, "aa", "s", 0, 1)] * 2 + [(None, lone + " theing", "aa", "s", 0, 1)] * 2 + [(None, clean[30][1], "aa", "s", 0, 1)]
    return docs, labels, {d[0] for d in clean}, {d[0] for d in clean[:20]}


def first_of_equal(rows):
    """Of equal texts the row with the largest id, once."""
    best = {}
    for i, text in rows:
        old = best.get(text or "")
        if old is None or (i is not None and (old[0] is None or i > old[0])):
            best[text or ""] = (i, text)
    return list(best.values())


def first_of_near(rows):
    """All pairs by the cosine of their sets of five words; of each component the row with the smallest id, and all without an id."""
    known = [r for r in rows if r[0] is not None]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in known)]
    up = list(range(len(known)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(known)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * (len(sets[i]) * len(sets[j])) ** 0.5 - 1e-9:
                up[find(i)] = find(j)
    groups = {}
    for i, row in enumerate(known):
        groups[find(i)] = min(groups.get(find(i), row), row)
    return list(groups.values()) + [r for r in rows if r[0] is None]


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a piece at a time: the number of sequences."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in left if r >= n]
        if fits:
            left.remove(min(fits))
        left.append((min(fits) if fits else capacity) - n)
    return len(left)


BRUTE = {"exact_dedup": first_of_equal, "near_dedup": first_of_near}


def test_stages_take_effect(spark, tmp_path):
    docs, labels, clean, copied = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, length int")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, d, str(tmp_path)), name)
        if name != "packing":
            assert out.columns == d.columns
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if name in BRUTE:
            before, after = ([(r.doc_id, r.text) for r in x.select("doc_id", "text").collect()] for x in (d, out))
            assert sorted(after, key=str) == sorted(BRUTE[name](before), key=str)
        if name == "packing":
            assert out.select("sequence_id").distinct().count() == one_by_one([r["length"] for r in out.select("length").collect()], 1024)
        d = out
    near = {i for i in kept["exact_dedup"] if i and i >= 1000 and i != 3003}
    assert kept["toxicity"] == {x[0] for x in docs} - {i for i in range(300) if i % 5 == 0}
    assert kept["language"] == kept["toxicity"] - {3000, 3001, 3002}
    assert kept["exact_dedup"] == kept["language"] - copied  # the larger id of equal texts stays
    assert len(near) == 40 and kept["near_dedup"] == kept["exact_dedup"] - set(range(2000, 2020)) and None in kept["near_dedup"]
    assert kept["packing"] == kept["near_dedup"]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in run.select("doc_id").collect()} == kept["packing"]
    assert run.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0), str(tmp_path)).count() == 0
