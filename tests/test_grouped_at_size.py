"""Grouped statistics whose groups grow in number or in rows."""

import numpy as np
import pytest

from fringelake.operators import kernels


def test_frames_are_whitened_together_and_as_one_by_one(spark):
    rng, rows = np.random.default_rng(3), []
    shapes = [[(0, 1, 2)], [(0, 3, 1), (1, 5, 2)], [(0, 3, 1), (1, 5, 2), (0, 4, 2), (3, 5, 4)], [(7, 8, 9), (1, 2, 3)]]
    for frame in range(40):
        base = int(rng.integers(0, 1 << 40))
        rows += [(frame, float(rng.normal()), float(rng.uniform(0.1, 0.3)), *(base + x for x in legs)) for legs in shapes[frame % 4]]
    df = spark.createDataFrame(rows, "frame long, residual double, sigma double, s1 long, s2 long, s3 long").repartition(5)
    out = kernels.closure_chi2(df)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()  # one call a frame
    found = {r.frame: r for r in out.collect()}
    assert len(found) == 40
    for frame, r in found.items():
        own = [x for x in rows if x[0] == frame]
        residual, sigma, legs = np.array([x[1] for x in own]), np.array([x[2] for x in own]), np.array([x[3:] for x in own])
        z = kernels.whiten_closures(np.sin(residual), sigma, legs)
        assert (r.chi2, r["rank"]) == (pytest.approx(z @ z, rel=1e-9), len(z))
        assert r.log_norm == pytest.approx(kernels.closure_norm(sigma, legs), abs=1e-9)
        assert r.penalty == pytest.approx(np.sum((2 * np.sin(residual / 2) ** 2 / sigma) ** 2), rel=1e-12)
