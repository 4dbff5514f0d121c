import math
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidemark.llm import queries, whitening


def symmetric(seed, n, kind):
    r = np.random.default_rng(seed)
    q = np.linalg.qr(r.standard_normal((n, n)))[0]
    values = {"plain": r.standard_normal(n), "equal": r.integers(-2, 3, n).astype(float), "steep": 10.0 ** -np.arange(n), "close": 1 + 1e-9 * np.arange(n)}[kind]
    v = (q * values) @ q.T
    return (v + v.T) / 2


@given(st.integers(0, 10**6), st.integers(1, 12), st.sampled_from(["plain", "equal", "steep", "close"]), st.floats(-3, 3))
@settings(max_examples=200, deadline=None)
def test_counts_equal_the_spectrum(seed, n, kind, shift):
    v = symmetric(seed, n, kind)
    e = np.linalg.eigvalsh(v)
    if np.abs(e - shift).min() > 1e-12:
        assert whitening.count_above(v, shift) == (e > shift).sum()
    assert whitening.count_above(np.zeros((n, n)), 0.0) == 0
    assert whitening.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


@pytest.mark.parametrize("kind", ["plain", "equal", "steep", "close"])
def test_leading_pairs_equal_a_full_solver(kind):
    for seed, n in ((1, 1), (2, 3), (3, 20), (4, 64)):
        half = symmetric(seed, n, kind)
        v = half @ half.T
        values, vectors = whitening.leading(v, 16)
        want = np.linalg.eigvalsh(v)[::-1][:16]
        want = want[want >= 1e-10 * want[0]]
        assert len(values) >= (want > 2e-10 * want[0]).sum() and len(values) <= 16
        assert np.allclose(values, want[: len(values)], rtol=0, atol=1e-13 * want[0] * max(1, n))
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
        assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * want[0]


def test_deviations_beyond_63_bits():
    own = whitening.Fit(3 * 10**9, np.array([3 * 10**15 + 7, 5]), np.zeros(0), np.zeros((2, 0)), 0.0)
    x = np.array([[10**6 + 900, 0], [10**6, 1]])
    assert [int(v) for v in own.deviations(x)] == [sum((own.n * int(a) - int(s)) ** 2 for a, s in zip(row, own.sums)) for row in x]


def brute(rows):
    """vec_id -> (n, deviation, whitened or None) with a full solver; whitened up to signs."""
    whole = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in whole}))
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, vectors = np.linalg.eigh(c.T @ c / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    m = min(16, int((e > 1e-10 * e[0]).sum()))
    out = [(i, n, sum((n * a - int(b)) ** 2 for a, b in zip(x, s)), (np.array(x) - s / n) @ vectors[:, :m] / np.sqrt(e[:m])) for i, x in whole]
    return out, e[:m] / e.sum()


def frame(spark, rows):
    df = spark.createDataFrame([(i, v, 1.5, "x") for i, v in rows], "vec_id long, embedding array<float>, n double, x string")
    return df.repartition(4)


def compared(df, rows):
    want, explained = brute(rows)
    got = {}
    for r in df.collect():
        got.setdefault(r.vec_id, []).append(r)
    assert sum(map(len, got.values())) == len(want) * len(explained)
    signs = None
    for i, n, deviation, w in want:
        own = sorted(got[i], key=lambda r: r.component)
        own = own[:: len(own) // len(explained)]  # repeated rows are alike
        assert {r.n for r in own} == {n} and {int(r.deviation) for r in own} == {deviation}
        mine = np.array([r.whitened for r in own])
        if signs is None and np.abs(w).min() > 1e-3:
            signs = np.sign(w * mine)
        if signs is not None:
            assert np.allclose(mine, w * signs, atol=1e-6)
        assert np.allclose([r.explained for r in own], explained, rtol=1e-6)
        assert all(r.identity_error < 1e-6 for r in own)


def test_small_vectors_equal_a_full_solver(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1 + k) for k in range(6)]) for i in range(200)]
    rows += [(300, None), (301, [1.0, None] + [0.0] * 4), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (304, []), (None, [0.5] * 6)] + rows[:3] + [(305, rows[0][1])] * 40
    compared(whitening.whiten(whitening.quantized(frame(spark, rows))), rows)


def test_fewer_components_than_asked(spark):
    r = random.Random(6)
    rows = [(i, [a, b, a, b, 2.0]) for i in range(50) for a, b in [(float(r.randint(-9, 9)), float(r.randint(-3, 3)))]]
    out = whitening.whiten(whitening.quantized(frame(spark, rows)))
    assert out.select(F.max("component")).first()[0] == 2
    compared(out, rows)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        out = whitening.whiten(whitening.quantized(df))
        assert out.count() == 0 and out.columns[0] == "vec_id"
    with pytest.raises(ValueError):
        whitening.whiten(whitening.quantized(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_query_equals_a_full_solver(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    compared(queries.op12_whitening(spark, "/root/testdata/sf0.001"), rows)
