"""Byte-pair encoding and decoding.

The encoder keeps the symbols of a word in a doubly linked list and the adjacent
pairs with a merge rule in a priority queue ordered by (rank, position). A popped
entry whose symbols have meanwhile changed is stale and skipped. Decoding
concatenates the vocabulary's strings.

Null texts count as empty: no tokens. Texts are normalised and cut into words whole,
in one pass; a bounded memo spares repeated words the merging. Letters,
numbers, case pairs and the normal form are those of the library's Unicode version:
the tables below hold what the installed Python modules see otherwise. Other columns
of the table are never read, so their names may clash with the result's.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import TwoAges, map_texts, per_worker, whole_texts

#: White space as the tokenizers' regular expressions see it, a class body (it holds a range).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers of newer Unicode versions, which are neither to the library (class bodies).
LATER_LETTERS = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    "\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5"
    "\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    "\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LATER_NUMBERS = "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
#: Marks and parts of later Unicode versions that the library's normal form neither reorders nor joins (a class body).
INERT = (
    "\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    "\U00010d24-\U00010d27\U00010eab\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b"
    "\U0001145e\U00011839\U0001183a\U00011930\U0001193d\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42"
    "\U00011d44\U00011d45\U00011d97\U00011f41\U00011f42\U00016ff0\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae"
    "\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
)
#: Fixed values: (first, last, first of the lower-case forms, distance between capitals) of case pairs that the library has and Python 3.13 has not.
LATER_CASES = [
    (0x1C89, 0x1C89, 0x1C8A, 1),
    (0xA7CB, 0xA7CB, 0x0264, 1),
    (0xA7CC, 0xA7CE, 0xA7CD, 2),
    (0xA7D2, 0xA7D4, 0xA7D3, 2),
    (0xA7DA, 0xA7DA, 0xA7DB, 1),
    (0xA7DC, 0xA7DC, 0x019B, 1),
    (0x10D50, 0x10D65, 0x10D70, 1),
    (0x16EA0, 0x16EB8, 0x16EBB, 1),
]
_LOWER = {c: low + c - first for first, last, low, step in LATER_CASES for c in range(first, last + 1, step)}
_INERT = re.compile(f"([{INERT}])")
#: Ends of the code points that classes are looked up in: the first plane, which `re` keeps as a table, and all planes.
PLANE, PLANES = 0x10000, 0x110000
_OUTER = re.compile("[\U00010000-\U0010ffff]")
_HIGH = re.compile("[\u07fd-\U0010ffff]")  # all that _rare finds lies here


def planes(text: str) -> int:
    """Where the code points of a text end."""
    return PLANE if text.isascii() or not _OUTER.search(text) else PLANES


@functools.cache
def members(body: str, end: int) -> str:
    """The code points below `end` of a class of the regex module, as plain ranges for a class of `re`, which matches faster."""
    every = "".join(chr(c) for c in range(end) if not 0xD800 <= c < 0xE000)
    return "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(f"(?V1)[{body}]+", every))


@functools.cache
def _rare(end: int) -> re.Pattern:
    """Code points that need more than Python's normal form and lower case."""
    return re.compile(f"[{members(INERT + ''.join(map(chr, _LOWER)), end)}]")


def joined(strings: pa.Array, rows: list[np.ndarray], between: bytes) -> list[bytes]:
    """For each row of ids, their strings one after another."""
    ends = np.cumsum([0, *map(len, rows)])
    found = strings.take(pa.array(np.concatenate([np.empty(0, np.int32), *rows])))
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), found)
    return pc.binary_join(lists, pa.scalar(between, pa.large_binary())).to_pylist()


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Codec:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str, memo: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.specials.items()}
        self.suffix = model["end_of_word_suffix"] or ""
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        # a pair of adjacent ids, packed into one integer, has a rank; a rank has the joined symbol's id
        self.pairs = {self.vocab[x] << 20 | self.vocab[y]: rank for rank, (x, y) in enumerate(model["merges"])}
        self.joined = [self.vocab[x + y] for x, y in model["merges"]]
        stand_in = byte_symbols()
        self.inner = [self.vocab[c] for c in stand_in]
        self.final = [self.vocab[c + self.suffix] for c in stand_in]
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in self.specials) + ")")
        # ids of a word as bytes, so that a text's are one join
        self.words: dict[str, bytes] = TwoAges(lambda word: np.array(self.merge(word), np.int32).tobytes(), memo)
        self.cuts = functools.cache(self.cut)
        # what each id stands for in a decoded text, and in digits
        table = {c: b for b, c in enumerate(byte_symbols())}
        spell = str.encode if self.suffix else lambda s: s.encode() if s in self.specials else bytes(map(table.__getitem__, s))
        self.spelled = pa.array([spell(self.strings.get(i, "")) for i in range(max(self.strings) + 1)], pa.large_binary())
        self.digits = pa.array([str(i).encode() for i in range(len(self.spelled))], pa.large_binary())

    def cut(self, end: int) -> re.Pattern:
        """The vocabulary's pattern, for texts of code points below `end`."""
        letters, numbers = members(rf"\p{{L}}--[{LATER_LETTERS}]", end), members(rf"\p{{N}}--[{LATER_NUMBERS}]", end)
        letter, number, other = f"[{letters}]", f"[{numbers}]", f"[^{SPACE}{letters}{numbers}]"
        if self.lower:
            return re.compile(f"{letter}+|{number}|'(?:s|t|re|ve|m|ll|d)|{other}+")
        return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?{letter}+| ?{number}+| ?{other}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token. Queue entries are rank << 32 | position; an entry is stale
        if the pair that now starts at its position has another rank."""
        raw = word.encode("utf-8", "surrogatepass")
        inner, rank_of = self.inner, self.pairs.get
        ids = [inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        n = len(ids)
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(ids[i] << 20 | ids[i + 1])) is not None]
        if not queue:
            return ids
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if j >= n or (a := ids[i]) < 0 or rank_of(a << 20 | ids[j]) != rank:
                continue  # stale
            ids[i] = joined = self.joined[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(joined << 20 | ids[k])) is not None:
                    heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(ids[h] << 20 | joined)) is not None:
                heappush(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def normalize(self, text: str) -> str:
        if not self.lower:
            return text
        if text.isascii():
            return text.lower()
        if _HIGH.search(text) and _rare(planes(text)).search(text):
            parts = [p if i % 2 else unicodedata.normalize("NFC", p) for i, p in enumerate(_INERT.split(text))]
            text = "".join(parts).translate(_LOWER)
        else:
            text = unicodedata.normalize("NFC", text)
        # lower-case character by character: the capital sigma is all that looks at its neighbours
        return text.replace("Σ", "σ").lower()

    def plain(self, text: str) -> bytes:
        text = self.normalize(text)
        return b"".join(map(self.words.__getitem__, self.cuts(planes(text)).findall(text)))

    def packed(self, text: str) -> bytes:
        """The text's ids as 32-bit integers; special tokens cut it."""
        if "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return b"".join(np.int32(self.specials[p]).tobytes() if p in self.specials else self.plain(p) for p in parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode_all(self, rows: list[np.ndarray]) -> list[str]:
        """The vocabulary's strings; with an end-of-word suffix and no decoder they stand apart."""
        return [raw.decode("utf-8", "replace") for raw in joined(self.spelled, rows, b" " if self.suffix else b"")]

    def encode_all(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Ids of every text, and what they decode to."""
        ids = [np.frombuffer(self.packed(t), np.int32) for t in texts]
        return ids, self.decode_all(ids)

    def decode(self, ids: list[int]) -> str:
        return self.decode_all([np.array(ids, np.int32)])[0]


@per_worker
def codec(path: str) -> Codec:
    """One per Python worker."""
    return Codec(path)


def encode_texts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, decoded: the encoded and again decoded texts."""

    def make():
        own = codec(vocabulary)

        def run(batch):
            return [batch["doc_id"], *own.encode_all(batch["text"])]

        return run

    return map_texts(whole_texts(docs), make, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what encode_texts returns, taken in its task so that wide rows stay there.

    Empty and null texts have no tokens and the digests of the empty string. Rows
    with a null doc_id or a repeated one are kept as they are.
    """

    def make():
        own = codec(vocabulary)

        def run(batch):
            ids, decoded = own.encode_all(batch["text"])
            printed = joined(own.digits, ids, b" ")
            return [batch["doc_id"], list(map(len, ids)), [hashlib.sha256(x).hexdigest() for x in printed], [hashlib.sha256(x.encode()).hexdigest() for x in decoded]]

        return run

    return map_texts(whole_texts(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
