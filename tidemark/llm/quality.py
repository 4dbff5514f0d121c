"""Quality rules: plain counts, and the fertility of public tokenisers.

Per text, a public sentence-piece vocabulary and two byte-level ones give characters per
token; the pieces also give the share of byte-fallback tokens, and the entropy of their
distribution as a share of the most that so many tokens can have. For each language (the
lang column, else the script of most letters) bands are laid over the whole corpus:
quartiles widened by FENCE times their distance, and at least by the margins below. For
texts under FULL tokens the widening of characters per token and of entropy grows as one
over the root of their number. Texts outside their band are rejected: by characters per
token if most vocabularies say so, by byte share or entropy each alone. So are texts that
fail the base rules.

Null and empty texts: no words, all counts 0, failed. Texts are measured whole.
Tokens are taken word by word, each with the space before it (white space never lies
within a token). Repeated rows are judged each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
from collections import Counter

import numpy as np
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize, per_worker

SYMBOLS = "#*$%&|<>"
WINDOW = 8
FENCE = 3.0
#: Least half-widths of a band around its quartiles: characters per token, byte share, relative entropy.
MARGINS = {"chars_per_token": 0.2, "chars_per_byte_token": 0.2, "chars_per_multi_token": 0.2, "byte_share": 0.05, "entropy": 0.2}
#: The measures that vote on characters per token.
VOTERS = ("chars_per_token", "chars_per_byte_token", "chars_per_multi_token")
#: Tokens from which a band holds as it is; measures of fewer vary more.
FULL = 100
MAX_BANDS = 1000
#: Words whose tokens a worker remembers.
MEMO = 300_000
#: Characters of the texts that are measured together.
TOGETHER = 2_000_000
#: Code points looked up at a time, which bounds memory for very long texts.
SPAN = 1 << 20

_SPACES = " \t\n\x0b\x0c\r"
_WORD = re.compile(f"[^{_SPACES}]+")
_INNER_SPACE = re.compile(r"\s")


def repeated_words(code: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows of `width` words that occur twice or more in a text; equal words have equal codes."""
    n = len(code) - width + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, np.uint64)
    for i in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + code[i : i + n].astype(np.uint64) + np.uint64(1)
    order = np.argsort(rolled, kind="stable")
    ordered = rolled[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    # a hash may collide: every candidate is compared with its group's first window word by word
    first = np.concatenate([[True], ~same])
    leader = order[np.maximum.accumulate(np.where(first, np.arange(n), 0))]
    twin = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    at, lead = order[twin], leader[twin]
    equal = np.ones(len(at), bool)
    for i in range(width):
        equal &= code[at + i] == code[lead + i]
    if equal.all():
        starts = at
    else:
        seen = Counter(tuple(code[a : a + width].tolist()) for a in at)
        starts = np.array([a for a in at if seen[tuple(code[a : a + width].tolist())] > 1], int)
    covered = np.zeros(len(code) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, np.minimum(starts + width, len(code)), -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def words_of(text: str) -> list[str]:
    """Runs of other characters than ASCII white space."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return _WORD.findall(text)


def line_counts(text: str) -> tuple[int, int]:
    """n_symbols, n_dup_lines of one whole text."""
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


class Fertility:
    """Numbers the words that it meets and remembers their lengths and tokens."""

    def __init__(self, pieces: str, byte_level: tuple[str, ...], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.coders = [byte_coder(p, pattern) for p in byte_level]
        self.opens = [np.array([c.decode_single_token_bytes(i)[:1] == b" " for i in range(c.n_vocab)]) for c in self.coders]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.counts = np.zeros((4, 1024), np.int64)  # characters, pieces, tokens of the byte-level vocabularies
        self.starts = np.zeros(1024, np.int64)
        self.pieces, self.used = np.zeros(8192, np.int32), 0

    def learn(self, words: list[str]) -> None:
        """Number new words."""
        first, n = len(self.number), len(words)
        while first + n > self.counts.shape[1]:
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)], axis=1)
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        found = self.model.encode(words, num_threads=1)
        many = np.fromiter(map(len, found), np.int64, n)
        flat = np.fromiter((i for x in found for i in x), np.int32, int(many.sum()))
        while self.used + len(flat) > len(self.pieces):
            self.pieces = np.concatenate([self.pieces, np.zeros_like(self.pieces)])
        self.pieces[self.used : self.used + len(flat)] = flat
        self.starts[first : first + n] = self.used + np.cumsum(many) - many
        self.used += len(flat)
        own = self.counts[:, first : first + n]
        own[0], own[1] = np.fromiter(map(len, words), np.int64, n), many
        # each word opens with a space, which no token crosses; white space within words could join that of the next
        apart = np.fromiter((_INNER_SPACE.search(w) is not None for w in words), bool, n)
        joined = "".join(f" {w}" for w, x in zip(words, apart) if not x)
        for i, (coder, opens) in enumerate(zip(self.coders, self.opens)):
            ids = np.array(coder.encode_ordinary(joined), np.int64)
            own[2 + i, ~apart] = np.diff(np.append(np.nonzero(opens[ids])[0], len(ids)))
            own[2 + i, apart] = [len(coder.encode_ordinary(f" {w}")) for w, x in zip(words, apart) if x]
        self.number.update(zip(words, range(first, first + n)))

    def prepare(self, texts: list[list[str]]) -> None:
        """Number the words of some texts."""
        if len(self.number) > MEMO:
            self.forget()
        known = self.number
        if new := list(dict.fromkeys(w for words in texts for w in words if w not in known)):
            self.learn(new)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, list[int], int, float]:
        """(word numbers, [characters, pieces, tokens of each byte-level vocabulary], byte-fallback pieces,
        entropy in bits over log2 of the number of pieces) of one whole, prepared text."""
        code = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        totals = self.counts[:, code].sum(axis=1).tolist()
        many = self.counts[1, code]
        n = totals[1]
        ids = self.pieces[np.repeat(self.starts[code] - np.cumsum(many) + many, many) + np.arange(n)]
        n_bytes = int(self.is_byte[ids].sum())
        if n < 2:
            return code, totals, n_bytes, 0.0
        counts = np.unique(ids, return_counts=True)[1]
        p = counts / n
        return code, totals, n_bytes, float(-(p * np.log2(p)).sum() / np.log2(n))


def byte_coder(path: str, pattern: str) -> tiktoken.Encoding:
    """A byte-level vocabulary from a file of lines with a base64 token and its rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@per_worker
def fertility(pieces: str, byte_level: tuple[str, ...], pattern: str) -> Fertility:
    """One per Python worker."""
    return Fertility(pieces, byte_level, pattern)


@functools.cache
def scripts() -> tuple[np.ndarray, list[str]]:
    """Of each code point the number of its script if a letter, else 0; the scripts' names."""
    names: dict[str, int] = {"none": 0}
    of = np.array([names.setdefault(unicodedata.name(chr(c), "none").split(" ")[0].lower(), len(names)) if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint16)
    return of, list(names)


def script(text: str) -> str:
    """The script of most letters of the whole text."""
    of, names = scripts()
    total = np.zeros(len(names), np.int64)
    for at in range(0, len(text), SPAN):
        total += np.bincount(of[np.frombuffer(text[at : at + SPAN].encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=len(names))
    total[0] = 0
    return min((names[i] for i in np.nonzero(total == total.max())[0])) if total.any() else "none"


def measure(docs: DataFrame, pieces: str, byte_level: tuple[str, str], pattern: str) -> DataFrame:
    """doc_id, the base columns, band, n_tokens (pieces) and the measures of MARGINS."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def make():
        tokens = fertility(pieces, byte_level, pattern)

        def run(batch):
            out, texts = [], batch["text"]
            ends = np.cumsum([len(t) for t in texts]) // TOGETHER
            held: list[list[str]] = []
            for i, (doc_id, text, own) in enumerate(zip(batch["doc_id"], texts, batch["lang"])):
                if not held:
                    held = [words_of(t) for t, e in zip(texts[i:], ends[i:]) if e == ends[i]][::-1]
                    tokens.prepare(held)
                words = held.pop()
                code, (chars, n, *others), n_bytes, entropy = tokens(words)
                fertile = [chars / x if x else 0.0 for x in (n, *others)]
                band = own if own is not None else f"script:{script(text)}"
                out.append((doc_id, len(words), chars, *line_counts(text), repeated_words(code), band, n, *fertile, n_bytes / n if n else 0.0, entropy))
            return list(zip(*out))

        return run

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, band string, n_tokens long, " + ", ".join(f"{m} double" for m in MARGINS)
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang")), make, schema)


def bands(measured: DataFrame) -> DataFrame:
    """Per band and measure the quartiles over all rows with tokens, and how far beyond them is accepted."""
    columns = []
    for name, margin in MARGINS.items():
        rows = F.when(F.col("n_tokens") >= 1, F.col(name))
        q = F.percentile_approx(rows, [0.25, 0.75], 2000)
        spread = F.greatest(F.lit(FENCE) * (q[1] - q[0]), F.lit(margin))
        columns += [q[0].alias(f"{name}_low"), q[1].alias(f"{name}_high"), spread.alias(f"{name}_spread")]
    return measured.groupBy("band").agg(F.count("*").alias("band_rows"), *columns)


def judge(docs: DataFrame, pieces: str, byte_level: tuple[str, str], pattern: str) -> DataFrame:
    """One row per document: base columns, base_failed, measures, reasons and kept. pieces is a sentence-piece
    vocabulary, byte_level two byte-level ones, which split texts by the pattern."""
    measured = materialize(measure(docs, pieces, byte_level, pattern), "measures")
    limits = materialize(bands(measured), "bands")
    # the most frequent bands, a bounded number, settle their rows on the map side; rare ones are joined by a shuffle
    common = limits.orderBy(F.desc("band_rows"), "band").limit(MAX_BANDS)
    hits = measured.join(F.broadcast(common), "band")
    rest = measured.join(F.broadcast(common.select("band")), "band", "left_anti").join(limits, "band")
    rows = hits.unionByName(rest)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    wider = F.sqrt(F.greatest(F.lit(1.0), F.lit(float(FULL)) / F.col("n_tokens")))
    below = lambda m, w=1.0: F.col(m) < F.col(f"{m}_low") - w * F.col(f"{m}_spread")
    above = lambda m, w=1.0: F.col(m) > F.col(f"{m}_high") + w * F.col(f"{m}_spread")
    votes = sum((F.when(below(m, wider) | above(m, wider), 1).otherwise(0) for m in VOTERS), F.lit(0))
    outside = [F.when(2 * votes > len(VOTERS), "chars_per_token"), F.when(above("byte_share"), "byte_share"), F.when(below("entropy", wider), "entropy")]
    reasons = F.array_compact(F.array(*(F.when(F.col("n_tokens") >= 1, x) for x in outside)))
    out = rows.withColumn("base_failed", failed).withColumn("reasons", reasons).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons", "n_tokens", *MARGINS)
