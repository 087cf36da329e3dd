"""Harmonics: recurrences against NumPy, factors against their products, disks against quadrature over the azimuth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.functions import harmonics
from fringelake.functions.geometry import MAS
from fringelake.plans import models

KIND = f"id int, z {harmonics.COMPLEX}"


def frame(spark, arrays):
    return spark.createDataFrame([(i, [(float(z.real), float(z.imag)) for z in a]) for i, a in enumerate(arrays)], KIND)


def numbers(rows):
    return None if rows is None else np.array([r["re"] + 1j * r["im"] for r in rows])


def read(df, *columns):
    out = df.select("id", *[c.alias(f"x{i}") for i, c in enumerate(columns)]).orderBy("id").collect()
    return [[r[f"x{i}"] for i in range(len(columns))] for r in out]


def levinson(k):
    h = np.ones(1, complex)
    for x in k:
        h = np.append(h, 0) + x * np.conj(np.append(h, 0)[::-1])
    return h


def test_steps_up_and_down(spark):
    rng = np.random.default_rng(0)
    ks = [0.9 * rng.uniform(0, 1, n) * np.exp(1j * rng.uniform(0, 7, n)) for n in (0, 1, 2, 5)]
    df = frame(spark, ks)
    for k, (h, down) in zip(ks, read(df, harmonics.step_up(F.col("z")), harmonics.step_down(harmonics.step_up(F.col("z")))), strict=True):
        np.testing.assert_allclose(numbers(h), levinson(k), atol=1e-12)
        np.testing.assert_allclose(numbers(down["k"]), k, atol=1e-9)
        assert not down["clipped"]
    outside = frame(spark, [np.array([2.0, 3.0 + 1j])])
    ((down,),) = read(outside, harmonics.step_down(F.col("z")))
    assert down["clipped"] and abs(numbers(down["k"])[0]) == pytest.approx(harmonics.WITHIN)


def test_latents_stay_within_the_circle(spark):
    w = np.array([0, 1e-6, 0.3 - 0.2j, 5 + 1j])
    ((k,),) = read(frame(spark, [w]), harmonics.reflection_coefficients(F.col("z")))
    safe = np.where(np.abs(w) == 0, 1, np.abs(w))
    np.testing.assert_allclose(numbers(k), w * np.where(np.abs(w) == 0, 1, np.tanh(safe) / safe), atol=1e-9)


def test_factors_give_their_image_back(spark):
    rng = np.random.default_rng(2)
    hs = [levinson(0.8 * rng.uniform(0, 1, n) * np.exp(1j * rng.uniform(0, 7, n))) for n in (0, 1, 3, 4)]
    df = frame(spark, hs).withColumn("im", harmonics.image_harmonics(F.col("z")))
    c, s = harmonics.linear_form(F.col("im"))
    factors = read(harmonics.with_spectral_factor(df, "im"), F.col("factor"))
    for h, (factor,), (image, c, s, back) in zip(hs, factors, read(df, F.col("im"), c, s, harmonics.image_of_linear(c, s)), strict=True):
        auto = np.array([np.sum(h[m:] * np.conj(h[: len(h) - m])) for m in range(len(h))]) / np.sum(np.abs(h) ** 2)
        np.testing.assert_allclose(numbers(image), auto, atol=1e-12)
        np.testing.assert_allclose(numbers(factor), h, atol=1e-6)
        np.testing.assert_allclose(np.array(c) - 1j * np.array(s), 2 * auto[1:], atol=1e-12)
        np.testing.assert_allclose(numbers(back), auto, atol=1e-12)
    negative = frame(spark, [np.array([1.0, 0.9])])
    assert read(harmonics.with_spectral_factor(negative, "z"), F.col("factor")) == [[None]]


def test_bessel_orders_and_von_mises(spark):
    xs = [0.0, 1e-8, 0.3, 2.4, 11.0, -7.5, 60.0, 300.0]
    t = np.linspace(0, np.pi, 20001)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, x double")
    rows = read(df, harmonics.bessel_orders(F.col("x"), 6), harmonics.von_mises_harmonics(F.col("x"), F.lit(0.7), 4))
    for x, (j, v) in zip(xs, rows, strict=True):
        np.testing.assert_allclose(j, [np.trapezoid(np.cos(m * t - x * np.sin(t)), t) / np.pi for m in range(7)], atol=1e-10)
        if abs(x) < 100:
            w = np.exp(x * np.cos(t) - abs(x))
            ratio = np.array([np.trapezoid(np.cos(m * t) * w, t) / np.trapezoid(w, t) for m in range(5)])
            np.testing.assert_allclose(numbers(v), ratio * np.exp(-0.7j * np.arange(5)), atol=1e-7)


@pytest.mark.parametrize("opening", [0.0, 0.3])
def test_multipole_disks_equal_a_sum_over_the_disk(spark, opening):
    rng = np.random.default_rng(5)
    u, v = rng.uniform(-3e7, 3e7, (2, 8))
    df = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(u, v)], "u double, v double, wavel double")
    c, s, inc, pa = (0.4, -0.2, 0.1), (0.1, 0.3, 0.0), 50.0, 30.0
    disk = models.MultipoleDisk(profile=models.GaussianRing(radius=5.0, sigma=0.6), c=c, s=s, inc=inc, pa=pa, opening=opening)
    z = disk.cvis(models.samples_uv())
    found = np.array([r[0] + 1j * r[1] for r in df.select(z.re, z.im).collect()])
    x, w = np.polynomial.legendre.leggauss(32)
    r = 2 + 3 * (x + 1)
    w = w * r * np.exp(-0.5 * ((r - 5) / 0.6) ** 2)
    t = 2 * np.pi * np.arange(512) / 512
    bright = 1 + sum(a * np.cos((m + 1) * t) + b * np.sin((m + 1) * t) for m, (a, b) in enumerate(zip(c, s)))
    i, p = math.radians(inc), math.radians(pa)
    major, minor = np.outer(r, np.cos(t)), np.outer(r, np.sin(t)) * math.cos(i) + (r * opening * math.sin(i))[:, None]
    east, north = major * math.sin(p) + minor * math.cos(p), major * math.cos(p) - minor * math.sin(p)
    mass = np.outer(w, bright)
    want = [np.sum(mass * np.exp(-2j * np.pi * MAS * (a * east + b * north))) / mass.sum() for a, b in zip(u, v)]
    np.testing.assert_allclose(found, want, atol=1e-9)
    assert disk.parameters() == set()
