"""Limits: brackets against a loop in NumPy, positions without a crossing, and the polynomial against the brackets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.functions import special
from fringelake.functions.cx import real
from fringelake.functions.geometry import MAS, offset_phase
from fringelake.plans import grid, limits, models
from fringelake.plans.work import Table

COMPANION, SINGLE = models.BinaryCartesian(x="dra", y="ddec", ratio="flux"), models.PointSource()


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    u, v, wavel = rng.uniform(-60, 60, 40), rng.uniform(-60, 60, 40), rng.choice([3e-6, 3.2e-6], 40)
    rows = np.repeat(np.array([u, v, wavel]).T, 3, axis=0)
    value, error = 1 + 0.02 * rng.normal(size=120), rng.uniform(0.01, 0.03, 120)
    pdf = [(i, *map(float, r), float(d), float(e)) for i, (r, d, e) in enumerate(zip(rows, value, error))]
    return pdf, spark.createDataFrame(pdf, "sample_id long, u double, v double, wavel double, value double, error double").repartition(3)


CELLS = {"dra": [-8.0, 0.0, 3.0], "ddec": [0.0, 7.0]}


def plain(pdf, x, y, sigma, bounds, injected):
    _, u, v, w, d, e = map(np.array, zip(*pdf))

    def model(f):
        z = np.exp(-2j * np.pi * MAS * (u * x + v * y) / w)
        return np.abs((1 + f * z) / (1 + f)) ** 2

    base = np.sum(((1 - d) / e) ** 2)

    def reached(log):
        m = model(10**log)
        top = np.sum(((1 - d - (m - 1)) / e) ** 2) if injected else np.sum(((m - d) / e) ** 2)
        return special.nsigma_values(np.array([top]), np.array([base]), len(d))[0] >= sigma

    at, end = math.log10(bounds[0]), math.log10(bounds[1])
    if reached(at):
        return "below", None
    while not reached(at):
        if at == end:
            return "above", None
        low, at = at, min(at + 0.25, end)
    for _ in range(22):
        mid = (low + at) / 2
        low, at = (low, mid) if reached(mid) else (mid, at)
    return "crossed", 10 ** ((low + at) / 2)


@pytest.mark.parametrize("injected", [False, True])
@pytest.mark.parametrize("bounds", [(1e-5, 1.0), (2e-4, 0.006), (0.05, 0.9)])
def test_brackets_find_what_a_loop_finds(spark, data, injected, bounds):
    pdf, samples = data
    cells = grid.axes(spark, **CELLS)
    found = (limits.injection_limits if injected else limits.absil_limits)(samples, cells, COMPANION, SINGLE, 4.0, bounds=bounds)
    rows = found.collect()
    assert len(rows) == 6
    for r in rows:
        side, limit = plain(pdf, r.dra, r.ddec, 4.0, bounds, injected)
        assert (r.side, r.limit is None) == (side, limit is None)
        if limit:
            assert r.limit == pytest.approx(limit, rel=1e-6)
        else:
            assert 10**r.log_limit == pytest.approx(bounds[0 if side == "below" else 1])
    s = models.samples_uv()
    sums = limits.companion_sums(samples, cells, offset_phase(s.u, s.v, "dra", "ddec"), real(1.0), injected=injected, n_points=6)
    once = {r.point_id: r for r in limits.limits_from_sums(sums, 4.0, bounds).collect()}
    for r in rows:
        assert once[r.point_id].side == r.side and once[r.point_id].limit == (pytest.approx(r.limit, rel=1e-6) if r.limit else None)


def test_a_position_on_the_star_has_no_limit(spark, data):
    found = limits.absil_limits(data[1], grid.axes(spark, dra=[0.0], ddec=[0.0]), COMPANION, SINGLE, 4.0).collect()
    assert [(r.side, r.limit) for r in found] == [("above", None)]


def test_merged_samples_keep_the_likelihood(data):
    pdf, samples = data
    m = limits.merged(samples).collect()
    assert len(m) == 40 and sum(r.n for r in m) == 120
    chi2 = lambda a: sum(((a - r.value) / r.error) ** 2 + r.rest for r in m)
    assert chi2(0.9) == pytest.approx(sum(((0.9 - d) / e) ** 2 for *_, d, e in pdf), rel=1e-12)


def test_ratios_and_errors(spark, data):
    for sigma, n in ((3.0, 50), (5.0, 1000), (8.0, 10**6)):
        q = limits.ratio_of(sigma, n)
        assert special.nsigma_values(np.array([q]), np.array([1.0]), n)[0] == pytest.approx(sigma, abs=1e-6)
    for bad in (0.5, 99.0):
        with pytest.raises(ValueError, match="sigma"):
            limits.ratio_of(bad, 100)
    with pytest.raises(ValueError, match="bounds"):
        limits.solve(grid.axes(spark, dra=[0.0]), None, bounds=(0.0, 1.0))
    with pytest.raises(ValueError, match="no samples"):
        limits.absil_limits(data[1].limit(0), grid.axes(spark, dra=[0.0], ddec=[0.0]), COMPANION, SINGLE, 4.0)


def test_work_tables_can_be_dropped(spark):
    t = Table(spark.range(5).withColumn("x", F.col("id") * 2))
    assert t.df.count() == 5
    t.drop()
    with pytest.raises(Exception, match="(?i)path|exist|file"):
        spark.read.parquet(t.path).count()
