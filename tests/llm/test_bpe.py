import hashlib
import random
import time
import unicodedata

import public_tokenizers
import pytest
from tidemark.llm import bpe
from tidemark.llm.token_bytes import TokenBytes
from tokenizers import Tokenizer

BITS = ["a", "B", "é", "É", "é", " ", "\n", "\t", " ", " ", "'s", "'S", "'ll", "1", "23", "½", "٣", "<|endoftext|>", "<|startoftext|>", "<|", "ß", "İ", "Σ", "ς", "　", "\x1c", "\x85", "​", "😀", "中", "!!", "...", "́", "ﬁ", "\r\n", "_", "$", "worthless", "tionthe"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_equals_the_library(name):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), bpe.Codec(path, memo=50)  # a small memo turns over often
    r = random.Random(1)
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    texts += ["", " ", "x" * 5000, "ab" * 4000 + " " + "é" * 3000, "the quick brown fox " * 3000]
    packed = TokenBytes(path, "<u4") if name.startswith("byte") else None
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
        if packed:
            assert packed(text) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_byte_level_round_trip():
    own = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ["Ünï ☃ 😀\n\n x", "", "a  b\tc ", "\x00\x7f"]:
        assert own.decode(own.encode(text)) == text


def test_digests(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["Hello, WORLD", None, "", "  \n", "a<|endoftext|>b", "long text here " * 20000, "same", "same"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts[:-1])] + [(6, "same", 1), (None, "x", 1)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode_digests(df, path).collect()
    assert len(rows) == 9
    for row in rows:
        text = (texts[row.doc_id] or "") if row.doc_id is not None else "x"
        ids = library.encode(text, add_special_tokens=False).ids
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    wide = {r.doc_id: r for r in bpe.encode_texts(df.where("doc_id < 5"), path).collect()}
    assert wide[0].ids == library.encode("Hello, WORLD", add_special_tokens=False).ids and wide[1].ids == [] and wide[1].decoded == ""
    assert bpe.encode_digests(df.limit(0), path).count() == 0


def test_digests_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(5)
    texts = ["-", "---", "- -", " -\n", "\u2001", "\u2003\u2009", "\u2000\u200a", "\u2005-\u2006", "\u2028\u2029", "\u200b"]
    texts += ["".join(r.choice([*BITS, "-", "\u2003", "\u2009"]) for _ in range(r.randint(0, 14))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe.encode_digests(df, path).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_code_point_and_random_neighbours_equal_the_library(name):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), bpe.Codec(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"xa{chr(c)}b1" for c in points[i : i + 400]) for i in range(0, len(points), 400)]
    r = random.Random(3)
    marks = [c for c in points if unicodedata.combining(chr(c)) or unicodedata.category(chr(c))[0] == "M" or unicodedata.decomposition(chr(c))]
    pools = [points, range(0x20, 0x3000), marks, marks]
    pairs = ["".join(map(chr, r.choices(pools[i % 4], k=r.randint(2, 4)))) for i in range(100_000)]
    texts += [p for p in pairs if not any(0xD800 <= ord(c) < 0xE000 for c in p)]
    for at in range(0, len(texts), 2000):
        for text, want in zip(texts[at : at + 2000], library.encode_batch(texts[at : at + 2000], add_special_tokens=False)):
            assert own.encode(text) == want.ids, [hex(ord(c)) for c in text][:8]


def test_mixed_planes_sigmas_and_white_space_equal_the_library():
    bits = ["Σ", "ΑΣ", "σ.", "Ünï", "\U00010940", "\U0001d6a8", "\u0301", "\u0898\u0301", "\u2001", "\u2028", "\x1c", "\x85", "’s", "'S", "'", "!'ll", "中", "٣", "\ua7dc", "\u1c89", "\U00010d50", "😀", "a", "Word", " ", " ", "\n"]
    r = random.Random(11)
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 60))) for _ in range(4000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        library, own = Tokenizer.from_file(path), bpe.Codec(path)
        for text in texts:
            ids = library.encode(text, add_special_tokens=False).ids
            assert own.encode(text) == ids
            assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_new_case_and_punctuation_of_known_words_cost_little():
    own = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(7)
    words = ["".join(r.choices("etaoinshrdlu", k=9)) for _ in range(500)]
    forms = [f"{o}{w}{c}{e}" for w in words for w in (w, w.title(), w.upper()) for o in ("", "(", '"') for c in ("", ".", ",", "!") for e in ("", ")", '"', "###", "&&&")]
    r.shuffle(forms)
    own.encode(" ".join(words))
    at = time.process_time()
    for w in words * 40:
        own.merge(w)
    merges = time.process_time() - at
    at = time.process_time()
    own.encode(" ".join(forms))
    assert len(set(forms)) == 90_000 and time.process_time() - at < merges  # 90,000 forms: less than 20,000 merges
