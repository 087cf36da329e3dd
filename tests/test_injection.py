"""Injection and recovery against simulated data that are searched one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.functions.geometry import MAS
from fringelake.plans import grid, injection, models

FLUXES = [0.002, 0.01, 0.03, 0.1]


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.uniform(-60, 60, 2)), float(rng.choice([3e-6, 3.3e-6])), 1.0, float(rng.uniform(0.005, 0.02))) for i in range(150)]
    return spark.createDataFrame(rows, "sample_id long, u double, v double, wavel double, value double, error double").repartition(3)


def model(s, x, y, f):
    c = np.cos(2 * np.pi * MAS * (s.u * x + s.v * y) / s.wavel)
    return (1 + 2 * f * c + f * f) / (1 + f) ** 2


def test_every_draw_is_searched_as_by_itself(spark, samples):
    points = grid.axes(spark, dra=[-9.0, 0.0, 9.0], ddec=[-9.0, 9.0])
    planted = spark.createDataFrame([(0, 9.0, -9.0, 0.03), (1, -9.0, 9.0, 0.004), (2, 3.0, 1.0, 0.0)], "draw long, dra double, ddec double, flux double")
    found = {r.draw: r for r in injection.recovery(samples, planted, 3, points, FLUXES, seed=5, match_radius=1.0).collect()}
    assert sorted(found) == list(range(6))
    noise = samples.select("*", *[injection.normal(F.lit(5), F.lit(k).cast("long"), "sample_id").alias(f"z{k}") for k in range(6)]).toPandas()
    truth = [(0, 0, 0)] * 3 + [(9.0, -9.0, 0.03), (-9.0, 9.0, 0.004), (3.0, 1.0, 0.0)]
    spots = [(r.point_id, r.dra, r.ddec) for r in points.orderBy("point_id").collect()]
    for k, t in enumerate(truth):
        d = model(noise, *t) + noise.error * noise[f"z{k}"]
        base = (((1 - d) / noise.error) ** 2).sum()
        gains = {(i, f): base - (((model(noise, x, y, f) - d) / noise.error) ** 2).sum() for i, x, y in spots for f in FLUXES}
        best = max(gains, key=gains.get)
        r = found[k]
        assert r.delta_chi2 == pytest.approx(max(gains[best], 0), abs=1e-6)
        assert (r.point_id, r.flux) == (best if gains[best] > 0 else (None, None))
        snr = []
        for _, x, y in spots:
            g = 2 * (np.cos(2 * np.pi * MAS * (noise.u * x + noise.v * y) / noise.wavel) - 1) / noise.error
            snr.append((g * (d - 1) / noise.error).sum() / np.sqrt((g * g).sum()))
        assert r.snr == pytest.approx(max(snr), rel=1e-6)
    assert found[3].hit and found[3].flux == 0.03 and not found[0].hit and found[0].true_flux is None
    assert found[5].true_flux == 0.0


def test_grids_of_injections(spark):
    g = injection.injection_grid(spark, [2.0, 5.0], [0.1, 0.0, 0.3], 4, seed=1)
    rows = g.orderBy("draw").collect()
    assert len(rows) == 24 and [r.flux for r in rows[:12]] == [0.1] * 4 + [0.0] * 4 + [0.3] * 4
    assert [round(np.hypot(r.dra, r.ddec), 9) for r in rows] == [2.0] * 12 + [5.0] * 12
    assert len({round(np.arctan2(r.dra, r.ddec), 6) for r in rows}) == 24 and rows == g.orderBy("draw").collect()
    with pytest.raises(ValueError, match="n_pa"):
        injection.injection_grid(spark, [1.0], [0.1], 0)


def test_rescaled_errors(spark, samples):
    noisy = samples.withColumn("value", F.lit(1.0) + F.col("error") * 3.0)
    out, factor = injection.rescale_errors(noisy, models.PointSource())
    assert factor == pytest.approx(3.0)
    assert out.agg(F.avg(F.pow((F.col("value") - 1.0) / F.col("error"), 2.0))).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="perfectly"):
        injection.rescale_errors(samples, models.PointSource())


def test_bounds(spark, samples):
    points = grid.axes(spark, dra=[1.0], ddec=[1.0])
    with pytest.raises(ValueError, match="draws"):
        injection.search(samples, F.array(), injection.DRAWS + 1, points, FLUXES)
    with pytest.raises(ValueError, match="nothing"):
        injection.recovery(samples, spark.createDataFrame([], "draw long, dra double, ddec double, flux double"), 0, points, FLUXES)
