"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens are runs of letters, lower-cased. The chain has the states clean and toxic. Words
of a learned lexicon of stems (a word, or a beginning of words, of which a token takes the
longest it has) carry features: the stem, the shape of the word, and its context, which is
the distances to the lexicon words before and after it and the room between these or the
text's ends. All other words share one weight. Token labels come from document labels: in
a toxic document the stems are marked that are RATIO times as frequent in toxic documents
as in clean ones. Near copies of a toxic document count once there, however many they are.

Fit and marginals are exact over whole texts: stretches of other words are powers of one
2x2 matrix, so only lexicon words cost a step. A document's score is the noisy-or of its
marginals, the chance that any word is toxic, brought to the labels by a rising logistic
curve. Spans are the words with a marginal of MARK or more, neighbours joined.

Learning uses labelled rows whose crc32 of the id mod 4 is not 2: about SAMPLE of them, at
most twice as many, those with the smallest hashes of the id, so that the model does not
depend on partitions; lang, source and doc_id are no inputs. Null and empty texts score as
texts without lexicon words. Without toxic labels every score is near 0. Contradicting
labels of one id count as toxic if any does. Repeated rows are scored each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoAges, held_out, map_texts, materialize, release_caches, whole_texts
from .components import labels_of

#: Learning rows, about; at most twice as many are read.
SAMPLE = 20_000
#: Toxic documents that a stem needs, near copies aside; how much more frequent it must be there; a longer stem
#: must be so much purer than the one it begins with; letters of stems.
VOUCHERS, RATIO, PURER, STEMS = 6, 8.0, 2.0, range(3, 9)
#: Agreeing minima of 16 that make two toxic documents near copies.
NEAR = 5
#: Score of a toxic document, marginal of a toxic word.
THRESHOLD, MARK = 0.3, 0.5
#: Doublings that distances are told apart by.
STEPS = 16
#: Features besides the stems: shapes, distances before and after, the room between.
CONTEXT = 3 + 3 * STEPS

_WORDS = re.compile(r"[^\W\d_]+")


def doublings(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(n.astype(float))[1], STEPS - 1)


def shape(word: str) -> int:
    return 2 if word.isupper() and len(word) > 1 else int(word[:1].isupper())


def context(places: np.ndarray, shapes: np.ndarray, length: int) -> np.ndarray:
    """Features of the lexicon words at these places of a text: (words, 4) numbers below CONTEXT."""
    gaps = np.diff(places)
    before, after = np.concatenate([[0], gaps]), np.concatenate([gaps, [0]])  # 0: none
    room = np.concatenate([places[1:], [length]]) - np.concatenate([[-1], places[:-1]])
    return np.stack([shapes, 3 + doublings(before), 3 + STEPS + doublings(after), 3 + 2 * STEPS + doublings(room)], axis=1)


def powers(matrix: np.ndarray, exponents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(normalised powers of a positive 2x2 matrix, logarithms of what they were divided by)."""
    out, logs = np.tile(np.eye(2), (len(exponents), 1, 1)), np.zeros(len(exponents))
    base, log = matrix / matrix.sum(), np.log(matrix.sum())
    left = exponents.copy()
    while left.any():
        odd = left % 2 == 1
        out[odd] = out[odd] @ base
        total = out.sum(axis=(1, 2))
        out /= total[:, None, None]
        logs += np.log(total) + np.where(odd, log, 0.0)
        base, log, left = base @ base, 2 * log, left // 2
        log, base = log + np.log(base.sum()), base / base.sum()
    return out, logs


class Sequences:
    """Learning texts that have lexicon words, longest first, as arrays over all their lexicon words."""

    def __init__(self, rows: list[tuple[int, list[int], list[int], list[int], int]]):
        """(toxic, stems, places, shapes, words) of each text."""
        rows = sorted(rows, key=lambda r: (-len(r[1]), r))
        self.toxic = np.array([r[0] for r in rows])
        self.many = np.array([len(r[1]) for r in rows])
        self.first = np.concatenate([[0], np.cumsum(self.many)[:-1]]).astype(int)
        self.stems = np.concatenate([r[1] for r in rows])
        self.features = np.concatenate([context(np.array(r[2]), np.array(r[3]), r[4]) for r in rows])
        self.marks = np.repeat(self.toxic, self.many)
        places, lengths = np.concatenate([r[2] for r in rows]), np.array([r[4] for r in rows])
        starts = np.zeros(len(places), bool)
        starts[self.first] = True
        self.gap = places - np.where(starts, 0, np.concatenate([[-1], places[:-1]]) + 1)  # other words before each
        self.tail = lengths - places[self.first + self.many - 1] - 1
        self.exponents, self.of = np.unique(np.concatenate([self.gap, self.gap[starts] - 1, self.tail]).clip(0), return_inverse=True)
        close = np.concatenate([[False], (self.marks[:-1] == 1) & (np.diff(places) == 1)]) & ~starts & (self.marks == 1)
        last = np.zeros(len(places), bool)
        last[self.first + self.many - 1] = self.tail == 0
        n = self.marks.sum()
        leading = (starts & (self.gap == 0) & (self.marks == 1)).sum()
        #: Uses of start, clean to toxic, toxic to clean, toxic to toxic and of other words in the toxic state.
        self.used = np.array([leading, n - close.sum() - leading, n - close.sum() - (last & (self.marks == 1)).sum(), close.sum(), 0], float)


def chain(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp of (start, steps, other words) of the five weights of the chain; what is clean weighs 0."""
    return np.exp([0.0, theta[0]]), np.exp([[0.0, theta[1]], [theta[2], theta[3]]]), np.exp([0.0, theta[4]])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2x2 matrices, (2, 2, n) each."""
    return a[:, 0, None] * b[None, 0] + a[:, 1, None] * b[None, 1]


def scan(matrices: np.ndarray, room: np.ndarray, ahead: bool) -> tuple[np.ndarray, np.ndarray]:
    """(normalised products, logarithms of what they were divided by) of each of n matrices (2, 2, n) with the
    `room` ones before it (ahead) or after it, by doubling."""
    out, logs = matrices.copy(), np.zeros(matrices.shape[2])
    shift, at = 1, np.arange(len(room))
    while (at := at[room[at] >= shift]).size:
        other = at - shift if ahead else at + shift
        both = product(out[..., other], out[..., at]) if ahead else product(out[..., at], out[..., other])
        total = both.sum(axis=(0, 1))
        log = logs[other] + logs[at] + np.log(total)
        out[..., at], logs[at] = both / total, log
        shift *= 2
    return out, logs


def forward_backward(s: Sequences, theta: np.ndarray, node: np.ndarray, backward: bool = True) -> tuple[float, np.ndarray | None]:
    """(sum of log partition functions, P(toxic) of every lexicon word) for the words' weights node."""
    start, edge, other = chain(theta)
    power, logs = powers(edge * other, s.exponents)
    n = len(s.gap)
    gap, lead, tail = s.of[:n], s.of[n : n + len(s.many)], s.of[n + len(s.many) :]
    at_once = s.gap[s.first] == 0
    steps = np.moveaxis(power @ edge, 0, -1)[..., gap]
    steps[..., s.first] = 0.0
    steps[0][:, s.first] = np.where(at_once, start[:, None], ((start * other) @ power @ edge).T[:, lead])
    steps[:, 1] *= np.exp(np.minimum(node, 30))
    scale = steps.sum(axis=(0, 1))
    steps /= scale
    before = np.arange(n) - np.repeat(s.first, s.many)
    ends = s.first + s.many - 1
    closing = power.sum(axis=2).T[:, tail]
    ahead, held = scan(steps, before, True)
    inner = np.ones(n, bool)
    inner[s.first] = False
    total = np.log(scale).sum() + logs[gap[inner]].sum() + logs[lead[~at_once]].sum() + held[ends].sum() + logs[tail].sum()
    total += np.log((ahead[0][:, ends] * closing).sum(axis=0)).sum()
    if not backward:
        return total, None
    after, _ = scan(steps, np.repeat(s.many, s.many) - 1 - before, False)
    behind = np.empty((2, n))
    at = np.setdiff1d(np.arange(n), ends)
    behind[:, at] = (after[..., at + 1] * np.repeat(closing, s.many, axis=1)[None, :, at]).sum(axis=1)
    behind[:, ends] = closing
    p = ahead[0] * behind
    return total, p[1] / p.sum(axis=0)


class Field:
    """Weights of the chain over a lexicon of stems."""

    def __init__(self, lexicon: list[str]):
        """Stems; a whole word stands with a closing full stop."""
        self.lexicon = {w: i for i, w in enumerate(lexicon)}
        self.lengths = sorted({len(w) for w in lexicon if w[-1] != "."}, reverse=True)
        self.chain = np.zeros(5)
        self.word = np.zeros(len(lexicon))
        self.near = np.zeros(CONTEXT)
        self.curve = np.array([-3.0, 0.0])

    def fit(self, s: Sequences, rounds: int = 60, rate: float = 0.3, decay: float = 1.0) -> None:
        """Maximum likelihood with a Gaussian prior by Adam; the chain's five weights by differences."""
        k = len(self.word)
        theta = np.concatenate([[-2.0, -2.0, 0.0, 0.0, -4.0], np.zeros(k + CONTEXT)])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        small = 1e-4
        for n in range(1, rounds + 1):
            node = theta[5 : 5 + k][s.stems] + theta[5 + k :][s.features].sum(axis=1)
            total, p = forward_backward(s, theta[:5], node)
            if n % 5 == 1:  # five weights behind all the others move slowly
                slope = [(forward_backward(s, theta[:5] + small * np.eye(5)[i], node, False)[0] - total) / small for i in range(5)]
            left = s.marks - p
            near = np.bincount(s.features.ravel(), weights=np.repeat(left, s.features.shape[1]), minlength=CONTEXT)
            gradient = np.concatenate([s.used - slope, np.bincount(s.stems, weights=left, minlength=k), near]) - decay * theta
            gradient /= len(s.stems)
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            theta = theta + rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)
        self.chain, self.word, self.near = theta[:5], theta[5 : 5 + k], theta[5 + k :]

    @functools.cached_property
    def _gap(self):
        """Normalised transfer matrix over g other words, memoised; long gaps by squaring."""
        _, edge, other = chain(self.chain)
        one = edge * other / (edge * other).sum()

        @functools.lru_cache(100_000)
        def power(g: int) -> np.ndarray:
            if g == 0:
                return np.eye(2)
            half = power(g // 2)
            x = half @ half @ one if g % 2 else half @ half
            return x / x.sum()

        return power

    @functools.cached_property
    def _ids(self) -> TwoAges:
        return TwoAges(self.stem, 50_000)

    def stem(self, word: str) -> int:
        """The number of the whole word, or of its longest stem; -1 without one."""
        own = self.lexicon.get(word + ".")
        return own if own is not None else next((i for n in self.lengths if (i := self.lexicon.get(word[:n], -1)) >= 0), -1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_gap", "_ids")}

    def found(self, text: str) -> tuple[list[int], list[int], list[int], list[tuple[int, int]], int]:
        """(stems, places, shapes, spans of characters) of the lexicon words, and the number of words."""
        words = _WORDS.findall(text.lower())
        if not self.lexicon or max(map(self._ids.__getitem__, words), default=-1) < 0:
            return [], [], [], [], len(words)
        stems, places, shapes, spans, length = [], [], [], [], 0
        for m in _WORDS.finditer(text):
            own = self._ids[m[0].lower()]
            if own >= 0:
                stems.append(own)
                places.append(length)
                shapes.append(shape(m[0]))
                spans.append(m.span())
            length += 1
        return stems, places, shapes, spans, length

    def nodes(self, stems: list[int], places: list[int], shapes: list[int], length: int) -> np.ndarray:
        return self.word[stems] + self.near[context(np.array(places), np.array(shapes), length)].sum(axis=1)

    def marginals(self, nodes: np.ndarray, places: list[int], length: int) -> np.ndarray:
        """P(toxic) at the lexicon words, of weights nodes, at these places of a text of `length` words."""
        start, edge, other = chain(self.chain)
        power, n = self._gap, len(nodes)
        weight = np.exp(np.stack([np.zeros(n), np.minimum(nodes, 30)], axis=1))
        forward, backward = np.zeros((n, 2)), np.ones((n, 2))
        # the state before a lexicon word: the start, or what the gap before it leaves
        x = start if places[0] == 0 else ((start * other) @ power(places[0] - 1)) @ edge
        for i in range(n):
            if i:
                x = (forward[i - 1] @ power(places[i] - places[i - 1] - 1)) @ edge
            x = x * weight[i]
            forward[i] = x / x.sum()
        backward[n - 1] = power(length - places[n - 1] - 1) @ np.ones(2)
        for i in range(n - 2, -1, -1):
            x = power(places[i + 1] - places[i] - 1) @ (edge @ (weight[i + 1] * backward[i + 1]))
            backward[i] = x / x.sum()
        p = forward * backward
        return p[:, 1] / p.sum(axis=1)

    def score(self, p: np.ndarray) -> float:
        z = float(self.curve @ [1.0, either(p)])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def tag(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """(score, (start, end, largest marginal) of each toxic span) of one whole text."""
        stems, places, shapes, spans, length = self.found(text)
        if not stems:
            return self.score(np.zeros(0)), []
        p = self.marginals(self.nodes(stems, places, shapes, length), places, length)
        out: list[tuple[int, int, float]] = []
        before = -2
        for at, (a, b), x in zip(places, spans, p.tolist()):
            if x >= MARK:
                if at == before + 1:
                    out[-1] = (out[-1][0], b, max(out[-1][2], x))
                else:
                    out.append((a, b, x))
                before = at
        return self.score(p), out


def either(p: np.ndarray) -> float:
    """The noisy-or of the marginals, that any of the words is toxic, as the negative logarithm of the chance of none."""
    return min(30.0, -float(np.log1p(-np.minimum(p, 1 - 1e-9)).sum()))


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 0.1) -> np.ndarray:
    """Constant and rising slope by damped Newton steps."""
    x = np.stack([np.ones(len(x)), x], axis=1)
    w = np.zeros(2)
    keep = np.diag([1e-6, decay])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w -= step * min(1, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w if w[1] >= 0 else np.array([np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0])


def learning_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of about `sample` labelled rows that are not held out."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("labels")), F.lit(1 << 30)) < share * (1 << 30))
    one = drawn.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    first = one.orderBy(F.xxhash64("_id", F.lit("labels")), "_id").limit(2 * sample).collect()
    ids = spark.createDataFrame([tuple(r) for r in first], "_id long, toxic int")
    # at most 2 * sample rows of two numbers; of rows that repeat an id one text is learned, so that no id crowds out others
    texts = whole_texts(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).groupBy("_id", "toxic").agg(F.min("text").alias("text"))
    return materialize(texts.select("text", "toxic"), "learning")


def clusters(rows: DataFrame) -> dict[int, int]:
    """Text hash -> cluster of near copies among rows(text): texts that agree in NEAR of 16 minima over
    hashed word pairs. The learning sample bounds what the driver holds, 17 numbers a text."""

    def make():
        release_caches()
        own = np.random.default_rng(5)
        a, b = own.integers(1, 2**31, 16, np.uint64) * 2 + 1, own.integers(0, 2**32, 16, np.uint64)

        def run(batch):
            out = []
            for text in batch["text"]:
                w = ["", *_WORDS.findall(text.lower()), ""]
                h = np.array([zlib.crc32(f"{x} {y}".encode("utf-8", "surrogatepass")) for x, y in zip(w, w[1:])], np.uint64)
                out.append(((h[:, None] * a + b) % np.uint64(2**32)).min(axis=0).astype(np.int64).tolist())
            return [batch["key"], out]

        return run

    found = dict(sorted((r["key"], tuple(r["minima"])) for r in map_texts(rows.select("text", F.xxhash64("text").alias("key")), make, "key long, minima array<long>").collect()))
    if not found:
        return {}
    keys = list(found)
    minima, label = np.array([found[k] for k in keys]), np.arange(len(keys))
    for place in range(16):  # texts that agree in any minimum are compared, all with all
        order = np.argsort(minima[:, place], kind="stable")
        same = minima[order, place]
        for shift in range(1, len(keys)):
            at = np.nonzero(same[shift:] == same[:-shift])[0]
            if not len(at):
                break
            a, b = order[at], order[at + shift]
            apart = label[a] != label[b]  # what is connected already needs no further link
            a, b = a[apart], b[apart]
            near = (minima[a] == minima[b]).sum(axis=1) >= NEAR
            if near.any():
                own = np.arange(len(keys))
                label = labels_of(len(keys), np.concatenate([a[near], own]), np.concatenate([b[near], label]))
    return {k: keys[x] for k, x in zip(keys, label)}


def stems(word: str) -> list[str]:
    return [word + ".", *(word[:n] for n in STEMS if n <= len(word))]


def stem_counts(rows: DataFrame, keys: set[int] | None, wanted: dict | None) -> DataFrame:
    """stem, docs, places, over the texts of rows whose hash is in keys (None: all) and the stems in wanted
    (None: all); the stem '' counts texts and words."""
    shared = rows.sparkSession.sparkContext.broadcast((keys, None if wanted is None else set(wanted)))  # bounded by the learning sample

    def make():
        own, asked = shared.value

        def run(batch):
            docs, places = Counter(), Counter()
            for text, key in zip(batch["text"], batch["key"]):
                if own is None or key in own:
                    words = Counter(_WORDS.findall(text.lower()))
                    here = Counter()
                    for word, n in words.items():
                        for x in stems(word):
                            if asked is None or x in asked:
                                here[x] += n
                    places.update(here)
                    docs.update(here.keys())
                    docs[""] += 1
                    places[""] += words.total()
            return [list(docs), list(docs.values()), [places[x] for x in docs]]

        return run

    counted = map_texts(rows.select("text", F.xxhash64("text").alias("key")), make, "stem string, docs long, places long")
    return counted.groupBy("stem").agg(F.sum("docs").alias("docs"), F.sum("places").alias("places"))


def choose(toxic: dict[str, tuple[int, int]], clean: dict[str, tuple[int, int]]) -> list[str]:
    """Stems frequent in toxic texts only, shorter ones first; a longer one only if it is much purer."""
    all_toxic, all_clean = toxic.get("", (0, 1))[1], clean.get("", (0, 1))[1]
    pure: dict[str, float] = {}
    for x in sorted(toxic, key=lambda k: (len(k), k)):
        ratio = (toxic[x][1] + 0.5) / (all_toxic + 1) / ((clean.get(x, (0, 0))[1] + 0.5) / (all_clean + 1))
        if x and toxic[x][0] >= VOUCHERS and ratio >= RATIO:
            shorter = [pure[x[:n]] for n in range(min(STEMS), len(x)) if x[:n] in pure]
            if not shorter or ratio >= PURER * max(shorter):
                pure[x] = ratio
    return sorted(pure)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Lexicon, chain weights and calibration from docs(doc_id, text) and labels(doc_id, toxic)."""
    rows = learning_rows(docs, labels, sample)
    bad, good = rows.where("toxic = 1"), rows.where("toxic = 0")
    firsts = set(clusters(bad).values())  # of near copies one
    rest = F.col("docs") >= VOUCHERS
    toxic = {r["stem"]: (r["docs"], r["places"]) for r in stem_counts(bad, firsts, None).where(rest | (F.col("stem") == "")).collect()}
    clean = {r["stem"]: (r["docs"], r["places"]) for r in stem_counts(good, None, toxic).collect()}
    field = Field(choose(toxic, clean))

    if not field.lexicon:
        return field

    def make_rows():
        def run(batch):
            found = [field.found(text) for text in batch["text"]]
            return [batch["toxic"], *([x[i] for x in found] for i in (0, 1, 2, 4))]

        return run

    schema = "toxic int, stems array<int>, places array<int>, shapes array<int>, length long"
    drawn = sorted(tuple(r) for r in map_texts(rows, make_rows, schema).collect())  # lexicon words of the learning rows
    sequences = Sequences([r for r in drawn if r[1]])
    field.fit(sequences)
    node = field.word[sequences.stems] + field.near[sequences.features].sum(axis=1)
    p = forward_backward(sequences, field.chain, node)[1]
    seen = [either(p[a : a + n]) for a, n in zip(sequences.first, sequences.many)]
    rest = [r[0] for r in drawn if not r[1]]
    field.curve = logistic(np.array(seen + [either(np.zeros(0))] * len(rest)), np.array([*sequences.toxic, *rest], float))
    return field


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, predicted, spans(start, end, p) for every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # bounded by the learning sample

    def make():
        release_caches()
        own = shared.value

        def run(batch):
            found = [own.tag(t) for t in batch["text"]]
            spans = [[dict(zip(("start", "end", "p"), x)) for x in own_spans] for _, own_spans in found]
            return [batch["doc_id"], [x for x, _ in found], [int(x >= THRESHOLD) for x, _ in found], spans]

        return run

    return map_texts(whole_texts(docs), make, "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans."""
    return tag(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns untouched."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    names = docs.columns

    def make():
        release_caches()
        own = shared.value

        def run(batch):
            keep = [i for i, t in enumerate(batch["text"]) if own.tag(t or "")[0] < THRESHOLD]
            return [[batch[n][i] for i in keep] for n in names]

        return run

    return map_texts(docs, make, docs.schema)
