"""CLEAN in rounds against one component at a time, beams and convolutions against sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.functions.geometry import MAS
from fringelake.plans import cleaning

NPIX, SCALE = 20, 1.0
SOURCES = [(6, 5, 1.0), (12, 14, 0.6), (7, 6, 0.3)]


@pytest.fixture(scope="module")
def cleaned(spark):
    rng = np.random.default_rng(3)
    u, v = rng.normal(size=(2, 400)) * 4e7
    half = (NPIX - 1) / 2
    z = sum(f * np.exp(-2j * np.pi * MAS * SCALE * (u * (half - c) + v * (half - r))) for r, c, f in SOURCES)
    rows = [(float(a), float(b), float(x.real), float(x.imag), 1.0) for a, b, x in zip(u, v, z)]
    points = spark.createDataFrame(rows, "u double, v double, re double, im double, imaging_weight double").repartition(3)
    found = cleaning.clean(points, NPIX, SCALE, gain=0.2, threshold=2e-3, rounds=30, patch=6, tile=8)
    grid = np.arange(-(NPIX - 1), NPIX)
    beam = np.array([[np.mean(np.cos(2 * np.pi * MAS * SCALE * (u * c + v * r))) for c in grid] for r in grid])
    dirty = np.array([[np.mean((z * np.exp(2j * np.pi * MAS * SCALE * (u * (half - c) + v * (half - r)))).real) for c in range(NPIX)] for r in range(NPIX)])
    return found, beam, dirty


def image(df):
    out = np.zeros((NPIX, NPIX))
    for r in df.collect():
        out[r.row, r.col] = r.value
    return out


def seen(model, beam):
    """A model under a Gaussian beam, pixel by pixel."""
    a = np.radians(beam.pa)
    rr, cc = np.mgrid[0:NPIX, 0:NPIX]
    out = np.zeros((NPIX, NPIX))
    for r, c in zip(*np.nonzero(model)):
        north, east = -(rr - r), -(cc - c)
        along, across = north * np.cos(a) + east * np.sin(a), -north * np.sin(a) + east * np.cos(a)
        out += model[r, c] * np.exp(-4 * np.log(2) * ((along / beam.major) ** 2 + (across / beam.minor) ** 2))
    return out


def test_rounds_find_what_one_at_a_time_finds(cleaned):
    found, beam, dirty = cleaned
    left, model = dirty.copy(), np.zeros_like(dirty)
    for _ in range(5000):
        r, c = np.unravel_index(np.abs(left).argmax(), left.shape)
        if abs(left[r, c]) <= 2e-3:
            break
        f = 0.2 * left[r, c]
        model[r, c] += f
        left -= f * beam[NPIX - 1 - r : 2 * NPIX - 1 - r, NPIX - 1 - c : 2 * NPIX - 1 - c]
    got = image(found.model.df)
    assert np.abs(image(found.residual.df)).max() <= 2.1e-3
    # two sources lie within one beam, so that their sum and the restored map are what both ways agree on
    for m in (got, model):
        assert m[12, 14] == pytest.approx(0.6, abs=0.02) and m[4:10, 3:9].sum() == pytest.approx(1.3, abs=0.03)
    beam_of = cleaning.fit_beam(found.beam.df)
    np.testing.assert_allclose(image(found.restored(beam_of)), seen(model, beam_of) + left, atol=0.02)
    whole = sum(got[r, c] * beam[NPIX - 1 - r : 2 * NPIX - 1 - r, NPIX - 1 - c : 2 * NPIX - 1 - c] for r in range(NPIX) for c in range(NPIX))
    np.testing.assert_allclose(image(found.residual.df), dirty - whole, atol=1e-6)
    peaks = [x["peak"] for x in found.rounds]
    assert len(peaks) < 30 and peaks == sorted(peaks, reverse=True)


def test_restored_maps_are_the_model_under_the_beam(spark, cleaned):
    found, _, _ = cleaned
    fit = cleaning.fit_beam(found.beam.df)
    # the beam of normal baselines of this width is a Gaussian
    assert fit.major == pytest.approx(np.sqrt(8 * np.log(2)) / (2 * np.pi * 4e7 * MAS), rel=0.15) and fit.minor == pytest.approx(fit.major, rel=0.3)
    beam = cleaning.Beam(5.0, 3.0, 30.0)
    got, m, left = image(found.restored(beam)), image(found.model.df), image(found.residual.df)
    np.testing.assert_allclose(got, left + seen(m, beam), atol=1e-9)


def test_beams_are_fitted(spark):
    for major, minor, pa in ((7.0, 4.0, 25.0), (6.0, 5.0, 150.0)):
        kernel = cleaning.Beam(major, minor, pa).kernel(spark, 16).withColumnRenamed("value", "beam")
        fit = cleaning.fit_beam(kernel)
        assert (fit.major, fit.minor, fit.pa) == pytest.approx((major, minor, pa), rel=1e-6)
