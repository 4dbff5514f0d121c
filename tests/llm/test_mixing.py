import hashlib
import os
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F
from tidemark.llm import mixing, queries


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fill(sizes, weights, budget, epochs=3):
    """Clamp and share again until none is above, in fractions."""
    clamped = {}
    while True:
        rest, open_ = budget - sum(clamped.values()), {s: w for s, w in weights.items() if s not in clamped}
        target = clamped | {s: Fraction(w) * rest / sum(open_.values()) for s, w in open_.items()}
        over = {s: Fraction(epochs * sizes[s]) for s in open_ if target[s] > epochs * sizes[s]}
        if not over:
            return target
        clamped |= over


def brute(rows):
    by = {}
    for i, source, text in rows:
        by.setdefault(source, []).append((i, size(text)))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(z for _, z in by[s]) for s in by}
    target = fill(sizes, {s: k % 3 + 1 for k, s in enumerate(order)}, sum(sizes.values()))
    out = []
    for s in by:
        goal = float(target[s])
        ratio = goal / sizes[s] if sizes[s] else 0.0
        groups = {}
        for i, z in by[s]:
            h = hashlib.md5(":".join(["11"] + [str(i)] * (i is not None)).encode()).hexdigest()
            groups.setdefault(int(h[:8], 16) % max(1, -(-len(by[s]) // mixing.GROUP)), []).append((-z, h, i))
        for members in groups.values():
            owed = 0.0
            for z, h, i in sorted(members, key=lambda m: (m[0], m[1])):
                z, taken = -z, int(ratio)
                owed += (ratio - int(ratio)) * z
                if ratio % 1 and z and owed > int(h[24:], 16) / 2**32 * z:
                    owed -= z
                    taken += 1
                out.append((i, z, sizes[s], goal, z * taken))
    return sorted(out, key=str)


def table(seed, n=400):
    r = random.Random(seed)
    sources = ["hot"] * 12 + ["b", "é", "z", "\U0001f600", "", None, "tiny", "none"]
    rows = []
    for i in range(n):
        s = r.choice(sources)
        rows.append((i, s, None if s == "none" else "w " * (1 if s == "tiny" else r.choice([0, 1, 3, 40, 300]))))
    return rows + [(None, "b", "x y"), (None, "b", "x y"), (3, "b", "x\x0b\x1fy\tz"), (3, "b", "x\x0b\x1fy\tz"), (5, None, None), (9000, "z", "long " * 50000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, s, t, 0.5, "d") for i, s, t in rows], "doc_id long, source string, text string, share double, digest string")


@pytest.mark.parametrize("group", [1024, 7])
def test_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    rows = table(group)
    for parts in (1, 5):
        got = [(x.doc_id, x.size, x.source_size, x.target, x.size * x.repetitions) for x in mixing.plan(frame(spark, rows).repartition(parts)).collect()]
        assert sorted(got, key=str) == brute(rows)


def test_many_rounds_of_clamping(spark):
    sizes = [10**15, 3, 5, 9, 20, 50, 130, 400, 0, 1]
    df = spark.createDataFrame([(str(k), z, k % 3 + 1) for k, z in enumerate(sizes)], "source string, source_size long, weight long")
    for budget in (0, 7, 500, sum(sizes), 3 * sum(sizes), 4 * sum(sizes)):
        got = {r.source: r.target for r in mixing.water_fill(df, budget).collect()}
        want = fill(dict(enumerate(sizes)), {k: k % 3 + 1 for k in range(len(sizes))}, budget) if budget < 3 * sum(sizes) else {k: 3 * z for k, z in enumerate(sizes)}
        assert got == pytest.approx({str(k): float(v) for k, v in want.items()}, rel=1e-15)


def test_taken_words_come_near_the_target(spark):
    r = random.Random(2)
    rows = [(i, f"s{i % 7}", "w " * (5000 if i % 90 == 0 else r.randint(1, 200))) for i in range(2100)]
    for x in mixing.plan(frame(spark, rows)).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("repetitions")).alias("n")).collect():
        assert abs(x.n - x.target) < 0.002 * x.target


def test_no_size_is_left_out(spark):
    """Over many seeds, long and short texts are repeated about as often as the target asks."""
    rows = [(i, "ab"[i % 2], "w " * (100 if i % 10 < 2 else 10)) for i in range(80)]
    taken = Counter()
    sizes = mixing.measured(frame(spark, rows))
    found = mixing.targets(sizes)
    ratio = {r.source: r.target / r.source_size for r in found.collect()}
    for seed in range(12):
        for x in mixing.repetitions(sizes, found, seed).collect():
            taken[x.source, x.size] += x.repetitions
    share = {k: n / (12 * sum(1 for i, s, t in rows if (s, size(t)) == k)) for k, n in taken.items()}
    assert all(abs(v - ratio[s]) < 0.15 for (s, _), v in share.items())


def test_mix_repeats_whole_rows(spark):
    rows = table(4)
    df = frame(spark, rows)
    out = mixing.mix(df.repartition(3))
    assert out.columns == df.columns
    got = Counter((x.doc_id, x.source, x.text) for x in out.collect())
    want = Counter()
    for x in mixing.plan(df).collect():
        want[x.doc_id, x.source, x.size] += x.repetitions
    assert Counter({k: n for (i, s, t) in set(got) for k, n in [((i, s, size(t)), sum(m for (a, b, c), m in got.items() if (a, b, size(c)) == (i, s, size(t))))]}) == +want


def test_empty_tables(spark):
    df = frame(spark, table(1)).limit(0)
    assert mixing.plan(df).count() == 0 and mixing.mix(df).count() == 0
    nothing = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert sorted((x.doc_id, x.target, x.repetitions) for x in mixing.plan(nothing).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    df = queries.op11_mixing(spark, "/root/testdata/sf0.01")
    names = ", ".join(df.columns)
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.sql(f"SELECT {names} FROM ({queries.oracle_sql()['op11_mixing']})").fetchall())
