"""Embedding whitening: leading eigenvectors of the covariance by spectrum slicing.

The distinct vectors are the fit list. Spark sums it twice, first to the mean, then to the
products of what is left after the mean is taken off; each task hands on one partial sum. The
covariance has the square of the width in numbers (64 numbers a vector: 4096), whatever the
rows, and only it comes to the driver. There:

* The inertia of V - s I, read from the signs of an LDL' factorisation with symmetric pivots of one
  and two rows, counts the eigenvalues above s (Sylvester). Bisection on these counts
  isolates each leading eigenvalue.
* Inverse iteration at the middle of an interval, then Rayleigh quotient iteration, which converges
  cubically, gives the eigenpair. If it ends outside the interval, the interval is
  bisected further. Equal eigenvalues are an interval that cannot be split: each next vector is kept
  orthogonal to those found.
* Counts just above and just below every eigenvalue certify that it is the k-th one.

A last map projects every row; a pass over the fit list measures how far the covariance of the
whitened vectors is from the identity.

Rows whose vector is null, empty or holds null or non-finite entries go. Repeated rows give repeated
results and count once in the fit. Components whose variance is under RANK times the largest are no
components: constant vectors or an empty table give an empty result, as does a single vector. A null vec_id stays.
Vectors of different lengths fail the job. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

COMPONENTS = 16
#: Eigenvalues below this part of the largest one count as zero.
RANK = 1e-10
#: Bunch and Parlett's bound between pivots of one and of two rows.
PIVOT = (1 + 17**0.5) / 8
EPS = float(np.finfo(np.float64).eps)
#: Numbers of the vectors that are turned into doubles at a time.
CELLS = 1 << 20

RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def count_above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric v above shift: the positive pivots of the LDL' factorisation of v - shift I."""
    a = v - shift * np.eye(len(v))
    above = 0
    while len(a):
        size = np.abs(a)
        r, s = divmod(int(size.argmax()), len(a))
        p = int(size.diagonal().argmax())
        if not size[r, s] > 0:
            break  # what is left is zero
        if size[p, p] >= PIVOT * size[r, s]:
            rest = np.delete(np.arange(len(a)), p)
            above += a[p, p] > 0
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(column, column) / a[p, p]
        else:  # the off-diagonal entry outweighs both diagonal ones: one pivot of each sign
            rest = np.delete(np.arange(len(a)), [r, s])
            above += 1
            both = a[np.ix_(rest, [r, s])]
            a = a[np.ix_(rest, rest)] - both @ np.linalg.solve(a[np.ix_([r, s], [r, s])], both.T)
        a = (a + a.T) / 2
    return int(above)


class Slices:
    """Counts of the eigenvalues above the shifts asked for so far, which bracket every eigenvalue."""

    def __init__(self, v: np.ndarray):
        self.v = v
        self.norm = float(np.abs(v).sum(axis=1).max(initial=0.0))  # no eigenvalue is beyond it
        self.known = {-self.norm * (1 + 1e-9) - 1e-300: len(v), self.norm * (1 + 1e-9) + 1e-300: 0}

    def count(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = count_above(self.v, shift)
        return self.known[shift]

    def interval(self, k: int) -> tuple[float, float]:
        """The narrowest known interval that holds the k-th largest eigenvalue."""
        return max(s for s, n in self.known.items() if n >= k), min(s for s, n in self.known.items() if n < k)

    def halve(self, k: int) -> bool:
        """Halve the k-th eigenvalue's interval; False at the limit of doubles."""
        low, high = self.interval(k)
        if high - low <= 4 * EPS * self.norm:
            return False
        self.count((low + high) / 2)
        return True

    def isolate(self, k: int) -> None:
        """Halve until the interval holds no other eigenvalue, or cannot be told from a multiple one."""
        while True:
            low, high = self.interval(k)
            if self.known[low] - self.known[high] == 1 or not self.halve(k):
                return


def _solved(v: np.ndarray, shift: float, b: np.ndarray, norm: float) -> np.ndarray:
    """The direction of (v - shift I)^-1 b."""
    eye = np.eye(len(v))
    for bump in (0.0, EPS, 8 * EPS):
        try:
            y = np.linalg.solve(v - (shift + bump * norm) * eye, b)
        except np.linalg.LinAlgError:
            continue
        size = np.linalg.norm(y)
        if np.isfinite(size) and size > 0:
            return y / size
    return b


def _apart(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """x without its part along the vectors found, at length 1."""
    for _ in range(2):
        for e in found:
            x = x - (e @ x) * e
        x = x / np.linalg.norm(x)
    return x


def _rayleigh(v: np.ndarray, shift: float, start: np.ndarray, found: list[np.ndarray], norm: float) -> tuple[float, np.ndarray]:
    """The eigenpair that inverse iteration at shift and then Rayleigh quotient iteration lead to."""
    x = _apart(start, found)
    for _ in range(3):
        x = _apart(_solved(v, shift, x, norm), found)
    best = (np.inf, 0.0, x)
    for _ in range(12):
        e = float(x @ v @ x)
        residual = float(np.linalg.norm(v @ x - e * x))
        if residual >= best[0]:
            break  # rounding is all that is left
        best = (residual, e, x)
        x = _apart(_solved(v, e, x, norm), found)
    return best[1], best[2]


def leading(v: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of the covariance v: at most `components`, none below RANK of the first."""
    slices, random = Slices(v), np.random.default_rng(12)
    values: list[float] = []
    found: list[np.ndarray] = []
    slack = 64 * EPS * slices.norm * max(1, len(v)) ** 0.5
    for k in range(1, min(components, len(v)) + 1):
        if not slices.norm > 0 or slices.count(RANK * (values[0] if values else slices.norm)) < k:
            break
        slices.isolate(k)
        while True:
            low, high = slices.interval(k)
            e, x = _rayleigh(v, (low + high) / 2, random.standard_normal(len(v)), found, slices.norm)
            if low - slack <= e <= high + slack or not slices.halve(k):
                break
        if slices.count(e + slack) >= k or slices.count(e - slack) < k:
            raise ArithmeticError(f"eigenvalue {k} could not be certified")
        values.append(e)
        found.append(x * np.sign(x[np.abs(x).argmax()]))
    return np.array(values), np.array(found).reshape(len(found), len(v)).T


def quantized(embeddings: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, x: floor(scale * entry) + shift of the rows whose vector is whole."""
    entries = F.transform("embedding", lambda c: c.cast("double"))
    broken = F.exists("_c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("_c"))
    rows = rows.where(F.col("_c").isNotNull() & (F.size("_c") > 0) & ~broken)
    return rows.select("vec_id", F.transform("_c", lambda c: (F.floor(c * scale) + shift).cast("long")).alias("x"))


@dataclass
class Fit:
    """n vectors of `width` numbers with the sums `sums`, and what whitens them."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        base = self.sums // self.n
        near = x - base
        if self.n * float(np.abs(near).max(initial=0)) >= 2.0**62:
            near = near.astype(object)
        return self.n * near - (self.sums - self.n * base)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """The sum of the squared numerators of each row, exactly."""
        y = self.numerators(x)
        if y.dtype == object or (y.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0) >= 2.0**62:
            y = y.astype(object)
        return (y * y).sum(axis=1)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _matrices(batches: Iterator[pa.RecordBatch], name: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with their vectors as the rows of a matrix of whole numbers."""
    for batch in batches:
        at = batch.schema.get_field_index(name)
        width = len(batch.column(at)[0]) if batch.num_rows else 1
        step = max(1, CELLS // width)
        for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
            yield part, part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for _, m in _matrices(batches):
        n, total = n + len(m), m.sum(axis=0) if total is None else total + m.sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n", "s"])


def _products(of):
    """Sums of the outer products of of(rows), a row of the matrix at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, m in _matrices(batches):
            c = of(m)
            total = c.T @ c if total is None else total + c.T @ c
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    return run


def _covariance(vectors: DataFrame, of, n: int, width: int) -> np.ndarray:
    """Mean of the outer products of of(rows), whose mean is zero; width * width sums come back."""
    parts = vectors.select("x").mapInArrow(_products(of), "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((width, width))
    for r in sums:
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2 / n


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The fit of vectors(x) taken once each; None without vectors."""
    distinct = materialize(vectors.select("x").distinct(), "fit")
    widths = distinct.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if widths[0] is None:
        return None
    if widths[0] != widths[1]:
        raise ValueError(f"vectors have {widths[0]} to {widths[1]} entries")
    sums = distinct.mapInArrow(_sums, "n long, s array<long>").select("n", F.posexplode("s").alias("j", "v")).groupBy("j").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).orderBy("j").collect()
    n = sums[0]["n"]
    own = Fit(n, np.array([r["v"] for r in sums], np.int64), np.zeros(0), np.zeros((widths[0], 0)), 0.0)
    v = _covariance(distinct, own.centred, n, widths[0])
    own.trace = float(v.trace())
    own.values, own.vectors = leading(v, components)
    if len(own.values):
        own.identity_error = float(np.abs(_covariance(distinct, own.whitened, n, len(own.values)) - np.eye(len(own.values))).max())
    return own


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of vectors(vec_id, x): a row for each
    component of each row. Deviations are whole numbers of up to 38 digits."""
    own = fit(vectors, components)
    if own is None or not len(own.values):
        return vectors.sparkSession.createDataFrame([], RESULT)
    many, share = len(own.values), own.values / own.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, m in _matrices(batches):
            deviations = own.deviations(m)
            exact = pa.array([Decimal(x) for x in deviations], pa.decimal128(38, 0)) if deviations.dtype == object else pa.array(deviations).cast(pa.decimal128(38, 0))
            each = np.repeat(np.arange(len(m)), many)
            columns = [
                part.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(m))),
                pa.array(np.full(len(each), own.n, np.int64)),
                exact.take(pa.array(each)),
                pa.array(own.whitened(m).ravel()),
                pa.array(np.tile(share, len(m))),
                pa.array(np.full(len(each), own.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in RESULT.split(", ")])

    return vectors.select("vec_id", "x").mapInArrow(run, RESULT)
