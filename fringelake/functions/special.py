"""Special functions: Bessel J as columns; normal, gamma and beta functions on arrays, with Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Polynomial coefficients for J0 and J1 (Abramowitz and Stegun, 9.4.1 to 9.4.6).
J0_SMALL = (1.0, -2.2499997, 1.2656208, -0.3163866, 0.0444479, -0.0039444, 0.0002100)
J0_MODULUS = (0.79788456, -0.00000077, -0.00552740, -0.00009512, 0.00137237, -0.00072805, 0.00014476)
J0_PHASE = (-0.78539816, -0.04166397, -0.00003954, 0.00262573, -0.00054125, -0.00029333, 0.00013558)
J1_SMALL = (0.5, -0.56249985, 0.21093573, -0.03954289, 0.00443319, -0.00031761, 0.00001109)
J1_MODULUS = (0.79788456, 0.00000156, 0.01659667, 0.00017105, -0.00249511, 0.00113653, -0.00020033)
J1_PHASE = (-2.35619449, 0.12499612, 0.00005650, -0.00637879, 0.00074348, 0.00079824, -0.00029166)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * x + F.lit(c)
    return out


def j0(x: Column) -> Column:
    a = F.abs(x)
    y, t = (a / 3.0) * (a / 3.0), 3.0 / F.greatest(a, F.lit(3.0))
    return F.when(a <= 3, _horner(y, J0_SMALL)).otherwise(_horner(t, J0_MODULUS) * F.cos(a + _horner(t, J0_PHASE)) / F.sqrt(F.greatest(a, F.lit(3.0))))


def hankel(x: Column, radii: list[Column], weights: list[Column]) -> Column:
    """Sum of weight times J0(x radius) over rings, as a loop over an array: unrolled, many rings pass the limits of generated code."""
    rings = F.array(*(F.struct(r.cast("double").alias("r"), w.cast("double").alias("w")) for r, w in zip(radii, weights)))
    return F.aggregate(rings, F.lit(0.0), lambda total, ring: total + ring["w"] * j0(x * ring["r"]))


def j1_over_x(x: Column) -> Column:
    """J1(x) / x, 1/2 at 0."""
    a = F.abs(x)
    big = F.greatest(a, F.lit(3.0))
    y, t = (a / 3.0) * (a / 3.0), 3.0 / big
    return F.when(a <= 3, _horner(y, J1_SMALL)).otherwise(_horner(t, J1_MODULUS) * F.cos(a + _horner(t, J1_PHASE)) / (F.sqrt(big) * big))


def j1(x: Column) -> Column:
    return x * j1_over_x(x)


def jn(n: int, x: Column) -> Column:
    """J of integer order by its integral over 64 equal steps, exact to rounding while |x| stays below about 60."""
    steps = 64
    total = F.lit(0.0)
    for k in range(steps):
        t = 2 * math.pi * (k + 0.5) / steps
        total = total + F.cos(F.lit(n * t) - x * math.sin(t))
    return total / steps


# On arrays -----------------------------------------------------------------------------------------------------------


def ndtr(x) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(x, float) / math.sqrt(2))


def ndtri(p) -> np.ndarray:
    """Normal quantile by bisection on the tail and Newton steps in the log of the tail."""
    p = np.asarray(p, float)
    tail = np.minimum(p, 1 - p)
    with np.errstate(all="ignore"):
        z = np.sqrt(np.maximum(-2 * np.log(np.maximum(tail, 1e-320)), 0))
        for _ in range(30):
            q = np.maximum(ndtr(-z), 1e-320)
            density = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
            z = z + np.clip((np.log(q) - np.log(np.maximum(tail, 1e-320))) * q / np.maximum(density, 1e-320), -1, 1)
        out = np.where(p < 0.5, -z, z)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, out))


#: From this shape on the incomplete gamma function is integrated: series and fraction take terms as the root of the shape.
LARGE_SHAPE = 1000.0
#: The integrand is followed down to exp(-FALL) of its start.
FALL = 42.0
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def _gammaincc_large(a: float, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma of a large shape: the tail beyond x, or up to it, by Gauss-Legendre nodes.

    With t = x (1 + v) the tail is x^a e^-x / Gamma(a) times the integral of exp((a - 1) log(1 + v) - x v), which falls
    from 1 without a turn. The cost does not depend on the shape.
    """
    x = np.minimum(x, 1e300)
    side = np.where(x < a, -1.0, 1.0)
    fall = lambda v: (a - 1) * np.log1p(side * v) - side * x * v
    with np.errstate(all="ignore"):
        mu = (x - a) / a
        stirling = 1 / (12 * a) - 1 / (360 * a**3)
        scale = np.exp(a * (np.log1p(mu) - mu) - stirling) * math.sqrt(a / (2 * math.pi))
        wide = 2 * math.sqrt(2 * FALL / (a - 1)) + 8 * FALL / (a - 1)
        low, high = np.zeros(x.shape), np.where(x < a, 1 - 1e-16, wide)
        for _ in range(60):
            mid = (low + high) / 2
            far = fall(mid) < -FALL
            low, high = np.where(far, low, mid), np.where(far, mid, high)
        part = sum(w * np.exp(fall(high * (z + 1) / 2)) for z, w in zip(_NODES.tolist(), _WEIGHTS.tolist())) * high / 2 * scale
    return np.clip(np.where(x < a, 1 - part, part), 0, 1)


def gammaincc(a: float, x) -> np.ndarray:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above, nodes for a large a."""
    x = np.asarray(x, float)
    if a > LARGE_SHAPE:
        return _gammaincc_large(a, x)
    scale = np.where(x > 0, np.exp(a * np.log(np.maximum(x, 1e-300)) - x - math.lgamma(a)), 0.0)
    low = np.minimum(x, a + 1)
    term = total = np.full(x.shape, 1 / a)
    for n in range(1, 600):
        term = term * low / (a + n)
        total = total + term
        if np.all(term < 1e-17 * total):
            break
    high = np.maximum(x, a + 1)
    tiny = 1e-300
    b = high + 1 - a
    c, d = np.full(x.shape, 1 / tiny), 1 / b
    h = d
    for i in range(1, 600):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-16):
            break
    return np.clip(np.where(x < a + 1, 1 - scale * total, scale * h), 0, 1)


def betainc(a: float, b: float, x) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction."""
    x = np.asarray(x, float)
    swap = x > (a + 1) / (a + b + 2)
    y = np.where(swap, 1 - x, x)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    with np.errstate(all="ignore"):
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(np.maximum(y, 1e-300)) + q * np.log1p(-np.minimum(y, 1 - 1e-16)))
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, 400):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = np.where(y > 0, front * h / p, 0.0)
    return np.where(swap, 1 - out, out)


def _bisect(f, target, low: float, high: float, steps: int = 200) -> np.ndarray:
    target = np.asarray(target, float)
    a, b = np.full(target.shape, low), np.full(target.shape, high)
    for _ in range(steps):
        m = (a + b) / 2
        up = f(m) < target
        a, b = np.where(up, m, a), np.where(up, b, m)
    return (a + b) / 2


def betaincinv(a: float, b: float, p) -> np.ndarray:
    return _bisect(lambda x: betainc(a, b, x), p, 0.0, 1.0)


def chi2ppf(p, df: float) -> np.ndarray:
    """Quantile of the chi-square distribution."""
    p = np.asarray(p, float)
    high = df + 60 * math.sqrt(2 * df) + 1500
    return np.where(p <= 0, 0.0, np.where(p >= 1, np.inf, 2 * _bisect(lambda x: 1 - gammaincc(df / 2, x), p, 0.0, high / 2)))


def clopper_pearson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """The exact interval of a binomial fraction."""
    tail = (1 - confidence) / 2
    low = 0.0 if k == 0 else float(betaincinv(k, n - k + 1, tail))
    return low, 1.0 if k == n else float(betaincinv(k + 1, n - k, 1 - tail))


def nsigma_values(test, true, ndof: float) -> np.ndarray:
    """Gaussian significance of a chi-square ratio: x = ndof test / true against a chi-square of ndof."""
    x = ndof * np.asarray(test, float) / np.asarray(true, float)
    return -ndtri(np.maximum(0.5 * gammaincc(ndof / 2, x / 2), 1e-300))


def ruffio_values(mean, sigma, percentile: float) -> np.ndarray:
    """Percentile of a normal cut off below zero."""
    mean, sigma = np.asarray(mean, float), np.asarray(sigma, float)
    return np.maximum(mean - sigma * ndtri((1 - percentile) * ndtr(mean / sigma)), 0)


@F.pandas_udf(DoubleType())
def nsigma(test: pd.Series, true: pd.Series, ndof: pd.Series) -> pd.Series:
    out = np.empty(len(test))
    for n in ndof.unique():
        at = (ndof == n).to_numpy()
        out[at] = nsigma_values(test[at], true[at], float(n))
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def ruffio_upper_limit(mean: pd.Series, sigma: pd.Series, percentile: pd.Series) -> pd.Series:
    out = np.empty(len(mean))
    for p in percentile.unique():
        at = (percentile == p).to_numpy()
        out[at] = ruffio_values(mean[at], sigma[at], float(p))
    return pd.Series(out)
