import numpy as np
import public_tokenizers
from tidemark.llm import token_counts
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def brute(ids):
    """(start, length, closed) of the documents of a list of ids."""
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == token_counts.SEPARATOR:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


def test_blocks_are_stitched(spark, tmp_path):
    r = np.random.default_rng(1)
    files = {}
    for k, (n, share) in enumerate([(1000, 0.2), (1000, 0.005), (64, 0.5), (300, 0), (0, 0), (1, 1)]):
        ids = np.where(r.random(n) < share, token_counts.SEPARATOR, r.integers(0, 50000, n))
        files[f"shard{k}.bin"] = ids.tolist()
        (tmp_path / f"shard{k}.bin").write_bytes(ids.astype(">u2").tobytes())
    (tmp_path / "part-odd").write_bytes(b"\x00\x01\xc4\x80\x00")
    for block in (1, 7, 64, 1 << 16):
        rows = token_counts.count_tokens(spark, str(tmp_path), block=block, header=0).collect()
        for name, ids in files.items():
            own = sorted((x.document, x.start, x.n_tokens, x.closed) for x in rows if x.file.endswith(name))
            assert own == [(i, *d) for i, d in enumerate(brute(ids))]
        odd = sorted((x.document, x.start, x.n_tokens, x.closed, x.damaged) for x in rows if x.file.endswith("odd"))
        assert odd == [(0, 0, 1, True, False), (1, 2, 0, False, True)]


def test_numbers_survive_any_block_size(spark, tmp_path):
    r = np.random.default_rng(4)
    docs = [(d, r.integers(0, 50000, n).astype(">u2").tobytes()) for d, n in [(0, 3), (None, 0), (-7, 11), (2**63 - 1, 1), (-(2**63), 0), (12345678901, 40), (12345678901, 40)]]
    end = token_counts.SEPARATOR.to_bytes(2, "big")
    (tmp_path / "part-0").write_bytes(b"".join(token_counts.header_of(d) + t + end for d, t in docs))
    (tmp_path / "part-1").write_bytes(token_counts.header_of(9) + b"\x00\x01" + end + token_counts.header_of(8)[:4])
    for block in (1, 2, 5, 7, 1 << 16):
        rows = token_counts.count_tokens(spark, str(tmp_path), block=block).collect()
        own = [(x.doc_id, x.n_tokens, x.closed) for x in sorted(rows, key=lambda x: (x.file, x.document))]
        assert own == [*((d, len(t) // 2, True) for d, t in docs), (9, 1, True), (None, 0, False)]


def test_round_trip_of_texts(spark, tmp_path, monkeypatch):
    texts = ["one two", None, "", "Ünï ☃ \x00", "<|endoftext|>", "Ā Ā", "line\nline\r\n", "long " * 90000, "long " * 90000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "lone", "x"), (3, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, file string").coalesce(1)
    own = Tokenizer.from_file(VOCABULARY)
    for name, row_bytes, file_rows in (("t", 1 << 20, 48), ("small", 10, 2)):
        monkeypatch.setattr(token_counts, "ROW_BYTES", row_bytes)
        monkeypatch.setattr(token_counts, "FILE_ROWS", file_rows)
        token_counts.write_tokens(df, VOCABULARY, str(tmp_path / name))
        got = token_counts.count_tokens(spark, str(tmp_path / name)).collect()
        want = [(i, len(own.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
        assert sorted(((x.doc_id, x.n_tokens) for x in got), key=str) == sorted(want, key=str) and all(x.closed for x in got)
    token_counts.write_tokens(df.limit(0), VOCABULARY, str(tmp_path / "e"))
    assert token_counts.count_tokens(spark, str(tmp_path / "e")).count() == 0
