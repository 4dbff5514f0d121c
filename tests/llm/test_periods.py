import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import periods


def brute(w):
    """Every maximal stretch with a period, kept if the period is its smallest one."""
    out, n = set(), len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and w[end] == w[end + q]:
                end += 1
            length = end - i + q
            part = w[i : i + length]
            if length >= max(6, 4 * q) and not any(all(part[t] == part[t + p] for t in range(length - p)) for p in range(1, q)):
                out.add((i, length, q))
            i = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts):
    numbers = [np.array([ord(c) for c in t], np.int64) for t in texts]
    ends = np.cumsum([len(t) for t in texts])
    rows = periods.find_runs(np.concatenate(numbers) if numbers else np.zeros(0, np.int64), ends)
    owner = np.searchsorted(ends, rows[:, 0], side="right")
    return [[(int(s - (ends[k] - len(texts[k]))), int(n), int(q)) for (s, n, q), o in zip(rows, owner) if o == k] for k in range(len(texts))]


@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_two_letters_equal_brute_force(texts):
    assert found(texts) == [brute(t) for t in texts]


def test_planted_periods_equal_brute_force():
    r = random.Random(3)
    texts = []
    for _ in range(150):
        unit = "".join(r.choice("abcd") for _ in range(r.randint(1, 23)))
        inner = (unit * 9)[: r.randint(3, 9 * len(unit))]
        texts.append("".join(r.choice("abcd") for _ in range(r.randint(0, 9))) + inner * r.choice([1, 1, 4, 5]) + "".join(r.choice("abcd") for _ in range(r.randint(0, 9))))
    assert found(texts) == [brute(t) for t in texts]
    assert sum(map(len, found(texts))) > 100


def test_fewer_than_four_periods_are_refused():
    with pytest.raises(ValueError):
        periods.find_runs(np.zeros(4, np.int64), np.array([4]), min_exponent=2)


def plain(doc_id, text):
    """The query's row, by the definitions."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = (sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)


def test_query_equals_brute_force(spark):
    r = random.Random(8)
    words = ["a", "b", "ü", "x y", "long" * 30, "\x1f", " "]
    rows = [(i, r.choice([" ", "\n", "\t \x0b\x0c\r "]).join(r.choices(words, k=r.randint(0, 70)))) for i in range(300)]
    rows += [(i, "a b c " * r.randint(1, 9)) for i in range(300, 340)] + [(None, "x " * 9), (None, None), (7, None), (8, ""), (8, ""), (9, " \n "), (500, "y z " * 20000)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, runs int, _w string").repartition(3)
    got = sorted((tuple(x) for x in periods.summary(periods.periodic_runs(periods.planted(df))).collect()), key=str)
    want = [plain(*x) for x in rows if x[0] != 500]
    assert [x for x in got if x[0] != 500] == sorted(want, key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 20
    assert [x[1] for x in got if x[0] == 500] == [1]


def test_batches_of_several_groups(spark, monkeypatch):
    assert list(periods._groups([])) == [(0, 0)]
    monkeypatch.setattr(periods, "BATCH_WORDS", 10)
    assert list(periods._groups([4, 5, 3, 30, 1])) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert periods.summary(periods.periodic_runs(periods.planted(df))).count() == 0
