"""Marginal likelihoods of block-arrow covariances against dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.plans.arrow import Arrow, station_modes

KIND = "x double, block long, modes array<struct<mode:int,value:double>>, s0 double, s1 double"


def made(width=0.7, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for block in range(6):
        for a, b in ((0, 1), (0, 2), (1, 2), (1, 7)) if block % 2 else ((0, 1),):
            modes = [(int(m), float(width * rng.normal())) for m in (a, b)]
            rows.append((float(rng.normal()), block, modes, float(width * rng.normal()), float(rng.normal())))
    rows += [(0.5, None, [(0, 1.0)], 1.0, 0.2), (0.1, 3, [], 0.3, 0.1)]
    return rows


def dense(rows, k, scale2):
    names = sorted({(b, m) for _, b, modes, *_ in rows if b is not None for m, _ in modes})
    u = np.zeros((len(rows), len(names) + k))
    for i, (_, b, modes, *s) in enumerate(rows):
        for m, v in modes if b is not None else []:
            u[i, names.index((b, m))] += v
        u[i, len(names) :] = s[:k]
    x = np.array([r[0] for r in rows])
    c = scale2 * np.eye(len(x)) + u @ u.T
    y = np.linalg.solve(scale2 * np.eye(u.shape[1]) + u.T @ u, u.T @ x)
    sign, log_det = np.linalg.slogdet(2 * np.pi * c)
    chi2 = x @ np.linalg.solve(c, x)
    return chi2, -0.5 * (chi2 + log_det), dict(zip(names, y)), y[len(names) :], float(np.sum((x - u @ y) ** 2))


@pytest.mark.parametrize("k", [0, 1, 2])
@pytest.mark.parametrize("scale2", [0.3, 1.0, 5.0])
def test_marginal_equals_the_dense_one(spark, k, scale2):
    rows = made()
    arrow = Arrow.of(spark.createDataFrame(rows, KIND).repartition(3), spanning=("s0", "s1")[:k])
    found = arrow.at(scale2)
    chi2, loglike, y, span, r2 = dense(rows, k, scale2)
    assert (found["chi2"], found["loglike"]) == pytest.approx((chi2, loglike), rel=1e-9)
    weights, s = arrow.weights(scale2)
    assert {(r.block, r.mode): r.weight for r in weights.collect()} == pytest.approx(y, rel=1e-8)
    assert s == pytest.approx(span, rel=1e-8)
    again = arrow.residual_power(scale2)
    assert (again["chi2"], again["r2"]) == pytest.approx((chi2, r2), rel=1e-9)
    arrow.drop()


def test_wide_nuisances_lose_few_digits_in_the_rows(spark):
    """Against least squares by orthogonal factors, which never square the matrix."""
    rows = made(width=3e4)
    names = sorted({(b, m) for _, b, modes, *_ in rows if b is not None for m, _ in modes})
    u = np.zeros((len(rows), len(names) + 1))
    for i, (_, b, modes, s0, _) in enumerate(rows):
        for m, v in modes if b is not None else []:
            u[i, names.index((b, m))] += v
        u[i, -1] = s0
    x = np.array([r[0] for r in rows])
    y = np.linalg.lstsq(np.vstack([u, np.eye(u.shape[1])]), np.append(x, np.zeros(u.shape[1])), rcond=None)[0]
    arrow = Arrow.of(spark.createDataFrame(rows, KIND), spanning=("s0",))
    found = arrow.residual_power()
    assert found["r2"] == pytest.approx(np.sum((x - u @ y) ** 2), rel=1e-6)
    assert found["chi2"] == pytest.approx(np.sum((x - u @ y) ** 2) + y @ y, rel=1e-6)


def test_no_rows_and_no_blocks(spark):
    empty = Arrow.of(spark.createDataFrame([], KIND), spanning=("s0",))
    assert empty.at() == pytest.approx({"chi2": 0.0, "norm": 0.0, "loglike": 0.0})
    bare = Arrow.of(spark.createDataFrame([(2.0, None, [], 0.0, 0.0)], KIND))
    assert bare.at(4.0) == pytest.approx({"chi2": 1.0, "norm": 0.0, "loglike": -0.5 - 0.5 * np.log(8 * np.pi)})


def test_station_modes(spark):
    df = spark.createDataFrame([(2, 5, 0.8, 0.1)], "station_a int, station_b int, model double, error double")
    row = df.select(F.explode(station_modes(0.05)).alias("m")).select("m.*").orderBy("mode").collect()
    assert [tuple(r) for r in row] == [(2, pytest.approx(0.8)), (5, pytest.approx(0.8))]
