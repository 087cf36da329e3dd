import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.operators import imaging
from fringelake.plans import inference, models
from fringelake.sources import generated

TRUE = {"diam": 2.0, "flux": 0.3}


def build(v):
    return models.System(parts=(models.UniformDisk(diam=v["diam"], flux=1.0), models.Resolved(flux=v["flux"])))


@pytest.fixture(scope="module")
def data(spark):
    samples = generated.tracks(spark)
    return samples.join(generated.simulate(samples, build(TRUE), sigma=1e-3, seed=3), "sample_id").cache()


def test_fit_recovers_the_truth(data):
    out = inference.fit(data, build, {"diam": 1.2, "flux": 0.1})
    sd = np.sqrt(np.diag(out.covariance))
    assert out.converged and abs(out.values["diam"] - 2) < 5 * sd[0] and abs(out.values["flux"] - 0.3) < 5 * sd[1]
    assert 40 < out.chi2 < 150
    cov = inference.laplace_covariance(data, build, out.values)
    assert np.sqrt(np.diag(cov)) == pytest.approx(sd, rel=0.1)


def test_smc_agrees_with_the_fit(data):
    out = inference.fit(data, build, {"diam": 1.8, "flux": 0.2})
    draws, log_z = inference.tempered_smc(data, build, {"diam": (1.5, 2.5), "flux": (0.1, 0.5)}, n=64, moves=2)
    assert draws["diam"].mean() == pytest.approx(out.values["diam"], abs=0.02) and np.isfinite(log_z)


def test_clean_finds_a_point(spark):
    rng = np.random.default_rng(0)
    u, v = rng.normal(size=(2, 200)) * 8e6
    mas = np.pi / 180 / 3600e3
    phase = -2 * np.pi * mas * (u * 5.0 + v * -5.0)
    rows = [(i, float(a), float(b), float(np.cos(p)), float(np.sin(p)), 1.0) for i, (a, b, p) in enumerate(zip(u, v, phase))]
    points = spark.createDataFrame(rows, "point_id long, u double, v double, re double, im double, imaging_weight double")
    model, residual = inference.clean(points, 9, 5.0, gain=0.3, minor=20, major=2)
    at = imaging.pixels(spark, 9, 5.0).where((F.col("dra") == 5) & (F.col("ddec") == -5)).first()
    assert model[at.row, at.col] == pytest.approx(1, abs=0.05) and np.abs(residual).max() < 0.05
