import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import packing
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a piece at a time: the number of sequences."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in left if r >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            left.append(capacity - n)
    return len(left)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_plan_is_best_fit_over_counts(lengths, capacity):
    counts = Counter(lengths)
    slots = sorted(packing.plan(counts, capacity))
    ends = {(a, b): (slots[i + 1][1] if i + 1 < len(slots) and slots[i + 1][0] == a else counts[a]) for i, (a, b, _, _) in enumerate(slots)}
    used = defaultdict(list)
    for length, rank, first, offset in slots:
        for r in range(rank, ends[length, rank]):
            used[first + r - rank].append((offset, length))
    assert Counter(n for v in used.values() for _, n in v) == counts
    for v in used.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(used) == one_by_one(lengths, capacity)


def test_packs_every_piece_of_every_text(spark):
    r = random.Random(5)
    words = ["alpha", "Beta,", "γάμμα", "\n", "12", "<|endoftext|>", "don't", "  ", "#"]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 80, 400, 3000]))) for _ in range(60)] + [None, "", "same", "same"]
    ids = [*range(len(texts) - 1), len(texts) - 2]
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, length int")
    rows = packing.pack(df, VOCABULARY).collect()
    own = Tokenizer.from_file(VOCABULARY)
    want = []
    for i, t in zip(ids, texts):
        e = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        for k, (s, n) in enumerate(packing.cut(len(e), 1024)):
            want.append((i, k, s, n, zlib.crc32(np.array(e[s : s + n], "<u4").tobytes())))
    assert sorted(tuple(x)[:5] for x in rows) == sorted(want)
    taken = defaultdict(list)
    for x in rows:
        taken[x.sequence_id].append((x.offset, x.length))
    for v in taken.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(taken) == one_by_one([x.length for x in rows], 1024)
    assert packing.pack(df.limit(0), VOCABULARY).count() == 0


def test_repeated_rows_without_ids_spread_over_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 50)
    rows = [(None, 0, 0, 9, 77)] * 2000 + [(i, 0, 0, 5, i) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3).write.parquet(str(tmp_path / "cuts"))
    cuts = spark.read.parquet(str(tmp_path / "cuts"))
    got = packing.ranked(cuts, {9: 2000, 5: 300}).collect()
    assert {n: sorted(r["rank"] for r in got if r.length == n) for n in (9, 5)} == {9: list(range(2000)), 5: list(range(300))}
