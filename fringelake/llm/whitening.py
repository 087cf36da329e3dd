"""Whitening of embeddings by a covariance that is summed without rounding errors to speak of.

Vectors are put on a grid of 1/64, and the covariance is of the distinct grid vectors. Every task cuts its centred
columns into slices of few bits, so that sums of products of slices are exact in doubles, and adds these to high and low
parts by two-sums; the parts of all tasks are merged the same way, row by row of the matrix. Eigenvectors come from
LAPACK's divide and conquer on the tridiagonal form (`syevd`), as the matrix is as large as a vector is long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release

#: Steps of the grid in a unit, and what is added to its numbers.
STEPS, SHIFT = 64, 1_000_000
#: Components returned at most.
COMPONENTS = 16
#: Grid numbers beyond this size are no exact doubles.
EXACT = 2.0**52
#: Bits of a slice, slices, and rows whose products are summed at once: 2 * 21 + 11 bits are exact in a double.
BITS, SLICES, BLOCK = 21, 4, 2048
#: Eigenvalues below this share of the largest, times the dimension, are rounding and have no component.
LEAST = 2.0**-50


def grid(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that have no null and no entry that isn't finite; x: floor(64 * c) + 1000000.

    Vectors with an entry of 2^46 or more in size go as well, as 64 times that is beyond the exact numbers.
    """
    c = F.transform("embedding", lambda v: v.cast("double") * STEPS)
    whole = embeddings.select("vec_id", c.alias("c")).where(F.col("c").isNotNull() & F.forall("c", lambda v: v.isNotNull() & (F.abs(v) < EXACT)))
    return whole.select("vec_id", F.transform("c", lambda v: F.floor(v) + SHIFT).alias("x"))


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as a double and what it lacks (Knuth)."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


class Sum:
    """Double-double sums of arrays of doubles."""

    def __init__(self, shape: tuple[int, ...]):
        self.high, self.low = np.zeros(shape), np.zeros(shape)

    def add(self, x: np.ndarray, low: np.ndarray | float = 0.0) -> None:
        s, e = two_sum(self.high, x)
        self.high, self.low = two_sum(s, e + (self.low + low))


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Arrays that add up to high + low, each of BITS bits below those of the one before, scaled by columns."""
    top = np.frexp(np.abs(high).max(axis=0, initial=0.0))[1] + 1
    out = []
    for k in range(1, SLICES + 1):
        unit = np.ldexp(1.5, top - k * BITS + 52)
        part = (high + unit) - unit
        out.append(part)
        high, low = two_sum(high - part, low)
    return out


def add_products(into: Sum, high: np.ndarray, low: np.ndarray) -> None:
    """Add the sum of the rows' outer products to `into`; each matrix product of slices is free of rounding."""
    parts = slices(high, low)
    for i in range(SLICES):
        for j in range(i, SLICES - i):
            one = parts[i].T @ parts[j]
            into.add(one)
            if i != j:
                into.add(one.T)


@dataclass(frozen=True)
class Centre:
    """n vectors and their mean: whole numbers `near`, and what is above them as two doubles."""

    n: int
    near: np.ndarray
    above: np.ndarray
    above_low: np.ndarray
    over: list[int]  # S - n * near

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        near = [(2 * s + n) // (2 * n) for s in sums]
        over = [s - n * m for s, m in zip(sums, near, strict=True)]
        above = [o / n for o in over]
        low = [float(Fraction(o, n) - Fraction(a)) for o, a in zip(over, above, strict=True)]
        return cls(n, np.array(near, dtype=np.int64), np.array(above), np.array(low), over)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = two_sum((x - self.near).astype(float), -self.above)
        return high, low - self.above_low

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2; None where a long can't hold it."""
        d = x - self.near
        if ((int(np.abs(d).max(initial=0)) + 1) * self.n) ** 2 * x.shape[1] < 2**63:
            each = d * self.n - np.array(self.over, dtype=np.int64)
            return (each * each).sum(axis=1).tolist()
        found = (sum((self.n * v - o) ** 2 for v, o in zip(row, self.over, strict=True)) for row in d.tolist())
        return [v if v < 2**63 else None for v in found]


@dataclass(frozen=True)
class Model:
    """Components as columns, already over the roots of their eigenvalues; NaN where an eigenvalue is nought."""

    centre: Centre
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float = float("nan")

    def whitened(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centre.centred(x)
        return high @ self.axes + low @ self.axes


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, places in it, matrix) for the vectors x of each length, BLOCK rows at most; empty vectors go."""
    for batch in batches:
        lists = batch.column("x")
        ends = np.asarray(lists.offsets)
        flat = np.asarray(lists.values)
        sizes = np.diff(ends)
        for size in np.unique(sizes[sizes > 0]):
            of = np.flatnonzero(sizes == size)
            for at in range(0, len(of), BLOCK):
                rows = of[at : at + BLOCK]
                yield batch, rows, flat[ends[rows][:, None] + np.arange(size)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n and exact sums by dimension, in two halves of 26 bits and more that no long overflows."""
    total: dict[int, list] = {}
    for _, _, x in _blocks(batches):
        t = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)])
        t[0] += len(x)
        t[1] += (x >> 26).sum(axis=0)
        t[2] += (x & (2**26 - 1)).sum(axis=0)
    for size, (n, high, low) in total.items():
        yield pa.RecordBatch.from_pydict({"size": [size] * size, "dim": list(range(size)), "n": [n] * size, "high": high, "low": low}, schema=_TOTALS)


def _matrix(rows: DataFrame, columns: dict[int, object]) -> DataFrame:
    """Sums of outer products of the columns that `columns[size](x)` gives as (high, low), merged over tasks by row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Sum] = {}
        for _, _, x in _blocks(batches):
            high, low = columns[x.shape[1]](x)
            add_products(found.setdefault(x.shape[1], Sum((high.shape[1],) * 2)), high, low)
        for size, s in found.items():
            n = len(s.high)
            yield pa.RecordBatch.from_pydict({"size": [size] * n, "dim": list(range(n)), "high": list(s.high), "low": list(s.low)}, schema=_PARTS)

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        into = Sum((len(part["high"].iloc[0]),))
        for high, low in zip(part["high"], part["low"], strict=True):
            into.add(np.asarray(high), np.asarray(low))
        return pd.DataFrame({"size": part["size"][:1], "dim": part["dim"][:1], "high": [into.high], "low": [into.low]})

    kind = "size int, dim int, high array<double>, low array<double>"
    return rows.mapInArrow(task, kind).groupBy("size", "dim").applyInPandas(merged, kind)


_TOTALS = pa.schema([("size", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])
_PARTS = pa.schema([("size", pa.int32()), ("dim", pa.int32()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))])


def _covariances(rows: DataFrame, columns: dict[int, object], n: dict[int, int]) -> dict[int, np.ndarray]:
    """The merged matrices, of as many numbers as a vector's length squared, over n."""
    out: dict[int, np.ndarray] = {}
    for r in _matrix(rows, columns).collect():
        out.setdefault(r["size"], np.empty((len(r["high"]),) * 2))[r["dim"]] = (np.array(r["high"]) + np.array(r["low"])) / n[r["size"]]
    return out


def _model(centre: Centre, covariance: np.ndarray) -> Model:
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:COMPONENTS], vectors[:, ::-1][:, :COMPONENTS]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    trace = float(np.trace(covariance))
    there = values > max(values[0], 0.0) * LEAST * len(covariance)
    with np.errstate(divide="ignore", invalid="ignore"):
        axes = np.where(there, vectors * np.sign(largest) / np.sqrt(values), np.nan)
        return Model(centre, axes, np.where(trace > 0, np.where(there, values, 0.0) / trace, np.nan))


def fit(x: DataFrame) -> dict[int, Model]:
    """One model for each length of vector in `x`, from its distinct vectors.

    What reaches the driver are sums and matrices of the lengths squared; vectors are taken to have few lengths.
    """
    once = materialize(x.select("x").distinct(), "whitening")
    kind = "size int, dim int, n long, high long, low long"
    of: dict[int, tuple[int, list[int]]] = {}
    total = once.mapInArrow(_sums, kind).groupBy("size", "dim").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    for r in total.orderBy("size", "dim").collect():
        of.setdefault(r["size"], (r["n"], []))[1].append((int(r["high"]) << 26) + int(r["low"]))
    centres = {size: Centre.of(n, sums) for size, (n, sums) in of.items()}
    n = {size: c.n for size, c in centres.items()}
    covariances = _covariances(once, {size: c.centred for size, c in centres.items()}, n)
    models = {size: _model(centres[size], v) for size, v in covariances.items()}
    # the covariance of what comes out, of the components that exist: its mean first, which is nought but for rounding
    there = {size: ~np.isnan(m.axes).any(axis=0) for size, m in models.items()}
    ones = lambda m, keep: lambda x: _with_one(m.whitened(x)[:, keep])
    means = {size: v[-1, :-1] for size, v in _covariances(once, {s: ones(m, there[s]) for s, m in models.items()}, n).items()}
    less = lambda m, keep, mean: lambda x: two_sum(m.whitened(x)[:, keep], -mean)
    shown = _covariances(once, {s: less(m, there[s], means[s]) for s, m in models.items()}, n)
    release(once)
    error = {size: float(np.abs(v - np.eye(len(v))).max(initial=0.0)) for size, v in shown.items()}
    return {size: Model(m.centre, m.axes, m.explained, error.get(size, 0.0)) for size, m in models.items()}


def _with_one(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    z = np.hstack([z, np.ones((len(z), 1))])
    return z, np.zeros_like(z)


def whiten(embeddings: DataFrame) -> DataFrame:
    """A row for each vector of `embeddings` (vec_id, embedding) and component, up to 16, or its length if less.

    Columns: vec_id, component (from 1, by falling eigenvalue), n (distinct vectors), deviation, whitened, explained and
    identity_error; see the module. Null vectors and such with a null or non-finite entry have no rows, and neither have
    empty ones, which have no component. Vectors of another length have a fit list and components of their own. Vectors
    that repeat count once in the fit, and each row is returned; null ids stay null. A component without variance (one
    vector, or constant or dependent entries) has whitened null, and explained 0, or null where nothing varies at all.
    A deviation that no long can hold is null. An empty table gives no rows; other columns are not read.
    """
    rows = grid(embeddings)
    models = fit(rows)
    kind = f"vec_id {dict(embeddings.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, x in _blocks(batches):
            m = models[x.shape[1]]
            z = m.whitened(x)
            k = z.shape[1]
            deviation = pa.array(m.centre.deviations(x), pa.int64())
            each = pa.array(np.repeat(np.arange(len(x)), k))
            column = lambda v: pa.array(v.ravel(), pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, m.centre.n, dtype=np.int64)),
                    deviation.take(each),
                    column(z),
                    column(np.tile(m.explained, len(x))),
                    pa.array(np.full(len(x) * k, m.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(apply, kind)
