import random

import numpy as np
import xxhash
from tidemark.llm import simhash
from tidemark.llm.components import components


def brute_fingerprint(text, words=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", low) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """fps: {id: fingerprint}"""
    up = {i: i for i in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for t in ["", " \n", "one", "a b c", "A b\tC d", "Ünï Çode wörd x y", "a b " * 50, "w " * 70000 + "end"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def test_classes_equal_brute_force(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(120)]
    fps = list(base)
    for _ in range(400):  # chains of close fingerprints around few centres
        x = r.choice(fps[:5] + fps)
        for b in r.sample(range(64), r.randint(0, 6)):
            x ^= 1 << b
        fps.append(x)
    want = brute_components(dict(enumerate(fps)))
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)]
    distinct = spark.createDataFrame(rows, "fp long, rep long").groupBy("fp").agg({"rep": "min"}).toDF("fp", "rep")
    for group in (4096, 16):  # 16: hot groups are dealt out in chunks
        found = {r.node: r.component for r in components(simhash.links(distinct, group=group)).collect()}
        reps = {r.rep for r in distinct.collect()}
        assert all(found.get(i, i) == want[i] for i in reps)


def test_edge_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(60000))
    rows = [(3, None, "x"), (1, "", "x"), (2, " \t", "x"), (7, long, None), (5, long + " tail", "x"), (9, "solo text of five words", "x"), (9, "solo text of five words", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()))
    assert [(i, c) for i, _, c in got] == [(1, 1), (2, 1), (3, 1), (5, 5), (7, 5), (9, 9), (9, 9)]
    assert {f for i, f, _ in got if i < 4} == {"0" * 16}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [1, 5, 9]
    shared = spark.createDataFrame([(4, "a text that stands alone here"), (2, "one two three four five six"), (4, "one two three four five six")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:3]) for r in simhash.keep_one(shared).collect()) == [(2, "one"), (4, "a t")]


def shingles(text, words=5):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def cosine(a, b):
    return len(a & b) / (len(a) * len(b)) ** 0.5


def test_similar_finds_the_similar_and_no_others(spark):
    r = random.Random(8)
    rows = []
    for c in range(40):
        w = [f"w{r.randrange(3000)}" for _ in range(r.choice([30, 90, 400, 900]))]
        for _ in range(r.choice([1, 2, 5])):
            v = list(w)
            for _ in range(r.choice([0, 1, len(w) // 90, len(w) // 12])):
                v[r.randrange(len(v))] = f"x{r.randrange(9999)}"
            rows.append((len(rows), " ".join(v)))
    rows += [(len(rows) + i, " ".join(f"w{r.randrange(3000)}" for _ in range(60)) + " one passage that many of the documents here share word for word") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(u, x):
        while u[x] != x:
            x = u[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if cosine(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(up, i), find(up, j)))
                up[b] = a
    for group in (4096, 16):
        got = {x.doc_id: x.component_id for x in simhash.similar(df, group=group).collect()}
        assert got == {i: find(up, i) for i in got}
    assert len({got[i] for i in got}) < len(rows)


def test_similar_decides_at_the_threshold_on_whole_sets(spark):
    r = random.Random(4)
    rows, linked = [], []
    for n in (454, 453, 1354, 1353):  # n - 4 shingles; every changed word costs both texts five: 0.8 itself, and just below
        for _ in range(15):
            w = [f"w{r.getrandbits(40)}" for _ in range(n)]
            v = list(w)
            for at in range(8, 8 + 9 * (n // 25), 9):
                v[at] = f"x{r.getrandbits(40)}"
            linked.append(cosine(shingles(" ".join(w)), shingles(" ".join(v))) >= 0.8)
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    assert sum(linked) == 30
    line = " ".join(f"v{r.getrandbits(40)}" for _ in range(12))
    rest = " ".join(f"u{r.getrandbits(40)}" for _ in range(200))
    rows += [(len(rows), f"{rest} {line}"), (len(rows) + 1, f"{rest} {' '.join([line] * 400)}")]  # one line again and again
    linked.append(True)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for group in (4096, 16):
        got = {x.doc_id: x.component_id for x in simhash.similar(df, group=group).collect()}
        assert [got[2 * i + 1] == got[2 * i] for i in range(len(linked))] == linked


def test_similar_keeps_texts_apart_that_share_an_id(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(4, "quite another text that has nothing in common"), (3, " ".join(words)), (4, " ".join([*words[:-1], "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:2]) for r in simhash.keep_one(df).collect()) == [(3, "w0"), (4, "qu")]


def test_of_repeated_rows_one_stays(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words), "b"), (1, " ".join(words), "a"), (1, " ".join([*words, "end"]), "c"), (2, " ".join(words), "d"), (None, " ".join(words), "e"), (None, None, "f"), (5, "lone", None), (5, "lone", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, once string")
    kept = sorted((str(r.doc_id), str(r.once)) for r in simhash.keep_one(df).collect())
    assert kept[:2] == [("1", kept[0][1]), ("5", "None")] and kept[2:] == [("None", "e"), ("None", "f")] and kept[0][1] in "ac"


def test_pivots_discard_most_pairs_and_no_similar_one():
    r = np.random.default_rng(2)
    sets, at = [], {}
    for n in [2, 3, 4, 5, 6, 8, 12, 13, 16, 25, 60, 200, 900] * 30:  # pairs just at the similarity, of equal and of unequal sizes
        other = n if r.random() < 0.5 else int(n / 0.7)
        common = int(np.ceil(0.8 * (n * other) ** 0.5 - 1e-9))
        if common > n:
            continue
        pool = r.integers(0, 2**64, n + other - common, np.uint64)
        at[len(sets)] = len(sets) + 1
        sets += [np.unique(pool[:n]), np.unique(pool[n - common :])]
    size, prints = np.array([len(s) for s in sets]), np.array([simhash.many(s) for s in sets])
    near = simhash.suspected([size, [p.tobytes() for p in prints]], 0.8)
    a, b = np.array(list(at)), np.array(list(at.values()))
    assert len(near(a, b)[0]) >= 0.99 * len(a)
    big = np.nonzero(size > 100)[0]
    a, b = big[r.integers(0, len(big), 20000)], big[r.integers(0, len(big), 20000)]
    apart = a // 2 != b // 2
    a, b = a[apart], b[apart]
    assert len(near(a, b)[0]) == 0  # unrelated sets are never suspects
    for t in range(simhash.TABLES):
        table = np.bitwise_count(prints[:, t, None] ^ simhash.pivots(simhash.COORDINATES)).astype(np.int8)
        far = np.abs(table[a] - table[b]).max(axis=1) > 12
        assert far.mean() > 0.5  # the pivots alone discard most
        assert (np.bitwise_count(prints[a, t] ^ prints[b, t])[far] > 12).all()  # and none within the radius
