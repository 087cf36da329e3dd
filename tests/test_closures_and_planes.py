"""Correlated closures against their covariance, and starlet planes by one scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.operators import imaging, kernels

LEGS = [(0, 3, 1), (0, 4, 2), (1, 5, 2), (3, 5, 4)]


def rows(spark, sigma):
    out = [(g, i, float(0.3 * i - g), sigma[i], *LEGS[i]) for g in range(3) for i in range(4 if g else 2)]
    return spark.createDataFrame(out, "frame long, tri_id long, residual double, sigma double, s1 long, s2 long, s3 long")


def test_norm_penalty_and_chi2_of_groups(spark):
    sigma = [0.1, 0.2, 0.15, 0.1]
    found = {r.frame: r for r in kernels.closure_chi2(rows(spark, sigma)).collect()}
    for g, m in ((0, 2), (1, 4), (2, 4)):
        t = kernels.incidence(np.array(LEGS[:m]))
        values, vectors = np.linalg.eigh(t @ t.T / 3)
        b = vectors[:, values > 1e-9]
        r = np.array([0.3 * i - g for i in range(m)])
        s = np.array(sigma[:m])
        x = b.T @ (np.sin(r) / s)
        assert found[g].chi2 == pytest.approx(x @ np.linalg.solve(b.T @ (t @ t.T / 3) @ b, x))
        assert found[g].penalty == pytest.approx((((1 - np.cos(r)) / s) ** 2).sum())
        norm = 0.5 * (np.linalg.slogdet(b.T @ (t @ t.T / 3) @ b)[1] + np.linalg.slogdet(b.T @ np.diag(s**2) @ b)[1])
        assert found[g].log_norm == pytest.approx(norm) and found[g]["rank"] == (2 if m == 2 else 3)


def test_draws_have_the_covariance_and_close_on_each_other(spark):
    sigma = [0.1, 0.1, 0.1, 0.1]
    d = kernels.closure_draws(rows(spark, sigma), 20_000, seed=4)
    pdf = d.where("frame = 1").toPandas().pivot(index="draw", columns="tri_id", values="residual").to_numpy()
    t = kernels.incidence(np.array(LEGS))
    np.testing.assert_allclose(np.cov(pdf.T), 0.01 * t @ t.T / 3, atol=4e-4)
    np.testing.assert_allclose(pdf @ [1, -1, 1, -1], 0, atol=1e-12)
    assert d.orderBy("frame", "tri_id", "draw").collect() == kernels.closure_draws(rows(spark, sigma).repartition(5), 20_000, seed=4).orderBy("frame", "tri_id", "draw").collect()


def test_planes_add_up_and_scan_the_image_once(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(9, 12))
    spark.createDataFrame([(1, r, c, float(v[r, c])) for r in range(9) for c in range(12) if (r, c) != (4, 4)], "image int, row int, col int, value double").write.parquet(str(tmp_path / "i"))
    image = spark.read.parquet(str(tmp_path / "i"))
    planes = imaging.starlet(image, ["image"], 4)
    assert str(planes._jdf.queryExecution().executedPlan()).count("Scan parquet") == 1
    sums = planes.groupBy("row", "col").agg(F.sum("value").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == 107 and all(r.n == 5 and r.s == pytest.approx(v[r.row, r.col]) for r in sums)
    taps, w = np.array(imaging.B3_SPLINE), np.where(np.arange(108).reshape(9, 12) == 52, 0, v)
    first = {(r.row, r.col): r.value for r in planes.where("scale = 0").collect()}
    pad = np.pad(w, 2)
    rowwise = sum(taps[k] * pad[k : k + 9, 2:-2] for k in range(5))
    rowwise[4, 4] = 0  # not a pixel: what falls there is lost
    smooth = sum(taps[k] * np.pad(rowwise, 2)[2:-2, k : k + 12] for k in range(5))
    assert all(x == pytest.approx(v[k] - smooth[k]) for k, x in first.items())
