"""Whole texts to packed token ids: a memo over chunks in front of a compiled tokenizer."""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken

from .bpe import SPACE, byte_symbols
from .common import TwoAges, per_worker


class TokenBytes:
    """Ids of a byte-level vocabulary (tokenizers JSON) as bytes of one fixed-width type.

    A chunk is a run of white space with the run of other characters that follows.
    Pre-tokens never cross a chunk's end, so chunks encode independently.
    """

    def __init__(self, path: str, dtype: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table = {c: b for b, c in enumerate(byte_symbols())}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(table.__getitem__, s)): i for s, i in spec["model"]["vocab"].items() if s not in self.specials}
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.coder = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        self.dtype = np.dtype(dtype)
        self.chunks = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.memo = TwoAges(self.pack, 100_000)

    def pack(self, chunk: str) -> bytes:
        return np.array(self.coder.encode_ordinary(chunk), self.dtype).tobytes()

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.chunks(text)))

    def __call__(self, text: str) -> bytes:
        if self.special is None or not any(s in text for s in self.specials):
            return self.plain(text)
        return b"".join(np.array([self.specials[p]], self.dtype).tobytes() if p in self.specials else self.plain(p) for p in self.special.split(text))


@per_worker
def token_bytes(path: str, dtype: str) -> TokenBytes:
    """One per Python worker."""
    return TokenBytes(path, dtype)
