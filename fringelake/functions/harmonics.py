"""Azimuthal harmonics of disks on columns: arrays of complex numbers, and recurrences as folds over them.

A profile is I(t) / I_0 = sum of I_m exp(i m t) with I_0 = 1 and I_-m the conjugate of I_m. The positive form is
|h(z)|^2 of a polynomial h whose reflection coefficients have moduli below one. A complex array is an array of (re, im).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Moduli of reflection coefficients from here on are cut to it: a root on the circle or within it.
WITHIN = 1.0 - 1e-6
COMPLEX = "array<struct<re:double,im:double>>"
#: Steps that a downward recurrence starts above the larger of order and argument.
ABOVE = 24


def cx(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def _times(a: Column, b: Column) -> Column:
    return cx(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def _conj(a: Column) -> Column:
    return cx(a["re"], -a["im"])


def _plus(a: Column, b: Column, sign: float = 1.0) -> Column:
    return cx(a["re"] + b["re"] * sign, a["im"] + b["im"] * sign)


def _at(x: Column, i: Column) -> Column:
    return F.coalesce(F.get(x, i.cast("int")), cx(F.lit(0.0), F.lit(0.0)))


def _range(first: Column | int, last: Column | int, body) -> Column:
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    none = F.filter(F.sequence(F.lit(0), F.lit(0)), lambda i: F.lit(False))
    return F.transform(F.when(last >= first, F.sequence(first, F.greatest(first, last))).otherwise(none), body)


def reflection_coefficients(latents: Column) -> Column:
    """k = w tanh|w| / |w| of every latent w, within the circle; the ratio is 1 at 0."""
    size = lambda w: F.sqrt(w["re"] * w["re"] + w["im"] * w["im"])
    ratio = lambda w: F.when(size(w) < 1e-4, 1.0 - size(w) * size(w) / 3.0).otherwise(F.tanh(size(w)) / F.greatest(size(w), F.lit(1e-300)))
    return F.transform(latents, lambda w: cx(w["re"] * ratio(w), w["im"] * ratio(w)))


def step_up(k: Column) -> Column:
    """h_0 to h_M, h_0 = 1, of the polynomial with reflection coefficients k_1 to k_M: each step mirrors the one before."""
    one = F.array(cx(F.lit(1.0), F.lit(0.0)))
    return F.aggregate(k, one, lambda h, kj: _range(0, F.size(h), lambda i: _plus(_at(h, i), _times(kj, _conj(_at(h, F.size(h) - i))))))


def step_down(h: Column) -> Column:
    """(k, clipped): the reflection coefficients of h, the inverse of `step_up`; moduli above WITHIN are cut to it."""
    first = F.get(h, F.lit(0))
    power = first["re"] * first["re"] + first["im"] * first["im"]
    scaled = F.transform(h, lambda x: _times(x, cx(first["re"] / power, -first["im"] / power)))
    begin = F.struct(scaled.cast(COMPLEX).alias("h"), F.array().cast(COMPLEX).alias("k"), F.lit(False).alias("clipped"))

    def step(s: Column, j: Column) -> Column:
        raw = _at(s["h"], j)
        size = F.sqrt(raw["re"] * raw["re"] + raw["im"] * raw["im"])
        cut = F.when(size > WITHIN, WITHIN / size).otherwise(1.0)
        held = F.array(cx(raw["re"] * cut, raw["im"] * cut))

        def lower(kj: Column) -> Column:
            rest = 1.0 - kj["re"] * kj["re"] - kj["im"] * kj["im"]
            return _range(0, j - 1, lambda i: (lambda z: cx(z["re"] / rest, z["im"] / rest))(_plus(_at(s["h"], i), _times(kj, _conj(_at(s["h"], j - i))), -1.0)))

        return F.struct(F.transform(held, lower)[0].cast(COMPLEX).alias("h"), F.concat(held, s["k"]).cast(COMPLEX).alias("k"), (s["clipped"] | (size > WITHIN)).alias("clipped"))

    down = F.when(F.size(h) > 1, F.sequence(F.size(h) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(down, begin, step, lambda s: F.struct(s["k"].alias("k"), s["clipped"].alias("clipped")))


def image_harmonics(h: Column) -> Column:
    """I_0 to I_M of |h|^2 over its mean: the autocorrelation of h, with I_0 exactly 1."""
    zero = cx(F.lit(0.0), F.lit(0.0))
    norm = F.aggregate(h, F.lit(0.0), lambda s, x: s + x["re"] * x["re"] + x["im"] * x["im"])

    def lag(m: Column) -> Column:
        total = F.aggregate(_range(0, F.size(h) - 1 - m, lambda i: _times(_at(h, i + m), _conj(_at(h, i)))), zero, lambda s, x: _plus(s, x))
        return F.when(m == 0, cx(F.lit(1.0), F.lit(0.0))).otherwise(cx(total["re"] / norm, total["im"] / norm))

    return _range(0, F.size(h) - 1, lag)


def linear_form(image: Column) -> tuple[Column, Column]:
    """c_m = 2 Re I_m and s_m = -2 Im I_m for m from 1."""
    rest = F.slice(image, 2, F.greatest(F.size(image) - 1, F.lit(0)))
    return F.transform(rest, lambda x: x["re"] * 2.0), F.transform(rest, lambda x: x["im"] * -2.0)


def image_of_linear(c: Column, s: Column) -> Column:
    """I_0 = 1 and I_m = (c_m - i s_m) / 2."""
    return F.concat(F.array(cx(F.lit(1.0), F.lit(0.0))), F.zip_with(c, s, lambda a, b: cx(a / 2.0, b / -2.0)))


def _factor(rows) -> list[dict] | None:
    """The polynomial with the roots outside the circle of one image, highest moduli first; null where it is negative."""
    if rows is None or not len(rows) or not rows[0]["re"] > 0:
        return None
    z = np.array([r["re"] + 1j * r["im"] for r in rows]) / rows[0]["re"]
    top = len(z) - 1
    n = max(4096, 16 * (top + 1))
    profile = 1 + 2 * (np.exp(2j * np.pi / n * np.outer(np.arange(n), np.arange(1, top + 1))) @ z[1:]).real
    if profile.min() < -1e-6:
        return None
    while top and abs(z[top]) < 1e-12:
        top -= 1
    h = np.ones(1, complex)
    if top:
        roots = np.roots(np.append(z[: top + 1][::-1], np.conj(z[1 : top + 1])))
        for r in roots[np.argsort(-np.abs(roots))[:top]]:
            h = np.append(h, 0) - np.append(0, h) / r
    return [{"re": float(x.real), "im": float(x.imag)} for x in np.append(h, np.zeros(len(z) - len(h)))]


def with_spectral_factor(df: DataFrame, image: str, name: str = "factor") -> DataFrame:
    """`df` with the minimum-phase h, h_0 = 1, for which |h|^2 is proportional to the image of harmonics in column `image`.

    Null where I_0 is not positive or the image is negative somewhere. Of 2 M roots, those M outside the circle are kept.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(**{name: [_factor(x) for x in pdf[image]]})

    return df.mapInPandas(task, StructType([*df.schema.fields, StructField(name, ArrayType(StructType([StructField(c, DoubleType()) for c in ("re", "im")])))]))


def _ladder(start: Column, orders: int, down, norm) -> Column:
    """Values of orders 0 to `orders` by a downward recurrence from `start`, divided by what `norm` sums up."""
    begin = F.struct(F.lit(0.0).alias("above"), F.lit(1e-300).alias("now"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("kept"))

    def step(s: Column, n: Column) -> Column:
        below = down(n, s["now"], s["above"])
        # a value so large that squares would overflow is brought down with all before it
        big = F.when(F.abs(below) > 1e200, 1e-200).otherwise(1.0)
        kept = F.when(n - 1 <= orders, F.concat(F.array(below), s["kept"])).otherwise(s["kept"])
        return F.struct((s["now"] * big).alias("above"), (below * big).alias("now"), ((s["sum"] + norm(n - 1, below)) * big).alias("sum"), F.transform(kept, lambda v: v * big).alias("kept"))

    return F.aggregate(F.sequence(start.cast("int"), F.lit(1), F.lit(-1)), begin, step, lambda s: F.transform(s["kept"], lambda v: v / s["sum"]))


def bessel_orders(x: Column, orders: int) -> Column:
    """J_0 to J_orders of |x| with the sign of odd orders, by one downward recurrence for all (Miller)."""
    a = F.greatest(F.abs(x), F.lit(1e-12))
    start = F.ceil(F.greatest(a, F.lit(float(orders))) * 1.1) + ABOVE
    found = _ladder(start, orders, lambda n, now, above: now * (n * 2.0 / a) - above, lambda n, v: F.when(n == 0, v).when(n % 2 == 0, v * 2.0).otherwise(0.0))
    return F.transform(found, lambda v, m: F.when((x < 0) & (m % 2 == 1), -v).otherwise(v))


def von_mises_harmonics(kappa: Column, theta0: Column, degree: int) -> Column:
    """I_0 to I_degree of a profile exp(kappa cos(t - theta0)): ratios of modified Bessel functions, turned by theta0."""
    a = F.greatest(F.abs(kappa), F.lit(1e-12))
    start = F.ceil(F.lit(float(degree)) + F.sqrt(a) * 8.0 + a * 0.2) + ABOVE
    values = _ladder(start, degree, lambda n, now, above: now * (n * 2.0 / a) + above, lambda n, v: F.when(n == 0, v).otherwise(0.0))
    signed = F.transform(values, lambda v, m: F.when((kappa < 0) & (m % 2 == 1), -v).otherwise(v))
    return F.transform(signed, lambda v, m: cx(v * F.cos(m * theta0), v * F.sin(m * theta0) * -1.0))


def ring_harmonics(q: Column, phi: Column, c: list[float], s: list[float]) -> Column:
    """(re, im) of a ring's visibility: sum of (-i)^m (c_m cos m phi + s_m sin m phi) J_m(q), c_0 = 1.

    q is 2 pi times the spatial frequency times the radius, phi its angle from the major axis.
    """
    orders = len(c)
    parts = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(float(a)).alias("c"), F.lit(float(b)).alias("s")) for m, (a, b) in enumerate(zip([1.0, *c], [0.0, *s], strict=True))))
    begin = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))

    def step(total: Column, x: Column) -> Column:
        v = (x["c"] * F.cos(x["m"] * phi) + x["s"] * F.sin(x["m"] * phi)) * x["j"]
        even, sign = x["m"] % 2 == 0, F.when(F.floor(x["m"] / 2) % 2 == 0, 1.0).otherwise(-1.0)
        return F.struct((total["re"] + F.when(even, v * sign).otherwise(0.0)).alias("re"), (total["im"] - F.when(even, 0.0).otherwise(v * sign)).alias("im"))

    with_bessel = F.zip_with(parts, bessel_orders(q, orders), lambda x, j: F.struct(x["m"].alias("m"), x["c"].alias("c"), x["s"].alias("s"), j.alias("j")))
    return F.aggregate(with_bessel, begin, step)
