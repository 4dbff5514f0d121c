import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import quality

VOCABULARIES = (public_tokenizers.path("piece_bpe_32k.model"), (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é\x85", "#x", "\n", "\n", "c\x1cd", "\xa0", "long", "\t", "|"]), max_size=80), st.sampled_from([" ", "  ", "\n"]))
def test_base_counts_equal_brute_force(parts, glue):
    text = glue.join(parts)
    words = quality.words_of(text)
    own = quality.fertility(*VOCABULARIES)
    own.prepare([words])
    code, (chars, *_), *_ = own(words)
    assert (len(words), chars, *quality.line_counts(text), quality.repeated_words(code)) == brute(text)


def test_verdicts_and_edges(spark):
    r = random.Random(1)
    words = ["the", "report", "states", "that", "rivers", "flow", "under", "stone", "bridges", "while", "children", "play", "music", "every", "evening", "near", "old", "harbour", "walls", "quietly"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(30, 200))), "en", 1) for i in range(300)]
    rows += [(900, None, "en", 1), (901, "", None, 1), (902, "too short", "en", 1), (903, "ὐ\U0001f9ff☃ " * 12 + " ".join(chr(0x13000 + r.randrange(900)) * 3 for _ in range(60)), "en", 1), (904, "same eight words in a row here again " * 9000, "en", 1), (905, rows[0][1], None, 1), (905, rows[0][1], None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    got = {x.doc_id: x for x in quality.judge(df, *VOCABULARIES).collect()}
    assert quality.judge(df, *VOCABULARIES).count() == len(rows)
    for i, text, *_ in rows:
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute(text or "") if len(text or "") < 99999 else x.n_repeat_words > 0
        assert x.base_failed == (x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words)
    assert sum(got[i].kept for i in range(300)) == sum(not got[i].base_failed for i in range(300))
    assert not got[903].kept and "byte_share" in got[903].reasons and got[905].kept
    assert quality.judge(df.limit(0), *VOCABULARIES).count() == 0


def test_short_texts_are_judged_too(spark):
    r = random.Random(6)
    words = ["the", "report", "states", "that", "rivers", "flow", "under", "stone", "bridges", "while", "children", "play", "music", "every", "evening", "near", "old", "harbour", "walls", "quietly"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(20, 200))), "en") for i in range(300)]
    rows += [(900 + i, " ".join("".join(r.choice("qxzjkvw") for _ in range(4)) for _ in range(21)), "en") for i in range(5)]
    got = {x.doc_id: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), *VOCABULARIES).collect()}
    assert all(got[i].n_tokens < 100 and "chars_per_token" in got[i].reasons and not got[i].kept for i in range(900, 905))
    assert all(got[i].kept != got[i].base_failed for i in range(300))


def test_script_counts_all_letters():
    assert quality.script("a слово " * 300) == "cyrillic"  # even words are Latin, as are half of the first letters
    assert quality.script(" ".join(["word", "слово"] * 300)) == "cyrillic"
    assert quality.script('"слово" (слово) a') == "cyrillic"
    assert quality.script("") == quality.script("12 %") == "none"


def test_tokens_equal_the_libraries(monkeypatch):
    import sentencepiece

    pieces, coders = sentencepiece.SentencePieceProcessor(model_file=VOCABULARIES[0]), [quality.byte_coder(p, VOCABULARIES[2]) for p in VOCABULARIES[1]]
    r = random.Random(3)
    bits = ["word", "réport", "\u4e2d\u6587", "\U0001f9ff", "x" * 40, "a", "don't", "12,5", "\u1f50", "\xa0", "b\x85c", "\u2003d", "\x1c"]
    for memo in (3, 300_000):
        monkeypatch.setattr(quality, "MEMO", memo)
        own = quality.Fertility(*VOCABULARIES)
        for _ in range(60):
            words = [r.choice(bits) + r.choice(["", "s", "é"]) for _ in range(r.randint(0, 30))]
            own.prepare([words])
            _, totals, n_bytes, entropy = own(words)
            ids = [i for w in words for i in pieces.encode(w)]
            assert totals == [sum(map(len, words)), len(ids), *(sum(len(c.encode_ordinary(f" {w}")) for w in words) for c in coders)]
            assert n_bytes == sum(map(pieces.is_byte, ids))
            p = np.array(list(Counter(ids).values())) / max(1, len(ids))
            assert np.isclose(entropy, -(p * np.log2(p)).sum() / np.log2(len(ids)) if len(ids) > 1 else 0)


def quartiles(values):
    v = sorted(values)
    return [v[max(0, -(-len(v) * k // 4) - 1)] for k in (1, 3)]


def test_verdicts_equal_brute_force(spark):
    r = random.Random(8)
    make = {"en": lambda: r.choice(["the", "river", "flows", "under", "bridges", "quietly", "evening"]), "fr": lambda: r.choice(["réunion", "où", "était", "maison", "été", "porte"])}
    rows = []
    for i in range(400):
        lang = r.choice(list(make))
        odd = r.random() < 0.1
        rows.append((i, " ".join("".join(r.choice("qxzjkvwü中ὐ") for _ in range(r.randint(2, 6))) if odd else make[lang]() for _ in range(r.randint(5, 120))), r.choice([lang, lang, None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = quality.judge(df, *VOCABULARIES).collect()
    band = {i: lang or f"script:{quality.script(text)}" for i, text, lang in rows}
    limits = {}
    for b in set(band.values()):
        own = [x for x in got if band[x.doc_id] == b and x.n_tokens]
        for m, margin in quality.MARGINS.items():
            low, high = quartiles([x[m] for x in own])
            limits[b, m] = low, high, max(3 * (high - low), margin)
    for x in got:
        wider = max(1.0, 100 / x.n_tokens) ** 0.5
        lim = lambda m: limits[band[x.doc_id], m]  # noqa: B023, E731
        votes = sum(x[m] < lim(m)[0] - wider * lim(m)[2] or x[m] > lim(m)[1] + wider * lim(m)[2] for m in quality.VOTERS)
        want = ["chars_per_token"] * (votes >= 2) + ["byte_share"] * (x.byte_share > lim("byte_share")[1] + lim("byte_share")[2]) + ["entropy"] * (x.entropy < lim("entropy")[0] - wider * lim("entropy")[2])
        assert x.reasons == want and x.kept == (not want and not x.base_failed)
    assert any(x.reasons for x in got) and any(x.kept for x in got)
