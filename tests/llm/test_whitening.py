"""Whitening against exact rational sums and the defining equations of the components."""

from fractions import Fraction

import numpy as np
import pytest

from fringelake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, x string, component string, whitened double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 0.5) for i, v in rows], SCHEMA).repartition(5)


def exact(vectors):
    """n, S and the covariance of the distinct grid vectors, in rationals."""
    x = sorted({tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v) for v in vectors})
    n, d = len(x), len(x[0])
    s = [sum(v[j] for v in x) for j in range(d)]
    c = [[n * v[j] - s[j] for j in range(d)] for v in x]
    return n, s, [[Fraction(sum(r[i] * r[j] for r in c), n**3) for j in range(d)] for i in range(d)]


def test_components_of_an_exact_covariance(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(400, 20)) @ rng.normal(size=(20, 20)) + 1000 * rng.normal(size=20)).astype(np.float32).tolist()
    rows = [*enumerate(vectors), *[(1000 + i, vectors[7]) for i in range(150)], (None, vectors[8])]
    found = whitening.whiten(frame(spark, rows)).toPandas()
    n, s, v = exact(vectors)
    assert len(found) == 551 * 16 and set(found["n"]) == {n}
    values = np.linalg.eigvalsh(np.array(v, dtype=float))[::-1]
    x = {i: [int(np.floor(64 * c)) + 1_000_000 for c in vec] for i, vec in rows}
    z = found[found["vec_id"] < 400].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    for r in found[found["component"] == 1].itertuples():
        key = None if np.isnan(r.vec_id) else int(r.vec_id)
        assert r.deviation == sum((n * a - b) ** 2 for a, b in zip(x[key], s, strict=True))
    explained = found.groupby("component")["explained"].first().to_numpy()
    np.testing.assert_allclose(explained, values[:16] / values.sum(), rtol=1e-9)
    assert found["identity_error"].nunique() == 1 and 0 <= found["identity_error"].iloc[0] < 1e-9
    np.testing.assert_allclose(z.T @ z / n, np.eye(16), atol=1e-9)
    # a component is an eigenvector: the covariance of the centred vectors with its scores is its root times itself
    c = np.array([x[i] for i in range(400)]) - np.array([float(Fraction(t, n)) for t in s])
    axes = (c.T @ z / n) / np.sqrt(values[:16])
    np.testing.assert_allclose(np.array(v, dtype=float) @ axes, axes * values[:16], rtol=1e-7, atol=1e-7 * values[0])


def test_sums_keep_what_doubles_lose():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**40), 2**40, size=(3000, 3))
    x[:, 2] = x[:, 0] + rng.integers(-1, 2, size=3000)
    rows = x.tolist()
    centre = whitening.Centre.of(3000, [sum(r[j] for r in rows) for j in range(3)])
    total = whitening.Sum((3, 3))
    for at in range(0, 3000, 512):
        whitening.add_products(total, *centre.centred(x[at : at + 512]))
    n, sums = 3000, [sum(r[j] for r in rows) for j in range(3)]
    for i in range(3):
        for j in range(3):
            true = Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in rows), n * n)
            assert abs(Fraction(total.high[i, j]) + Fraction(total.low[i, j]) - true) < Fraction(2) ** -70 * (2**80 * 3000)


def test_vectors_left_out_lengths_and_components_without_variance(spark):
    bad = [(1, None), (2, [1.0, None]), (3, [1.0, float("nan")]), (4, [float("inf"), 1.0]), (5, []), (6, [1e30, 1.0])]
    rows = [*bad, (10, [0.0, 1.0]), (11, [0.0, 2.0]), (12, [0.0, 4.0]), (13, [0.0, 4.0]), (20, [1.0, 2.0, 3.0])]
    found = whitening.whiten(frame(spark, rows)).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component) for r in found] == [(i, k) for i in (10, 11, 12, 13) for k in (1, 2)] + [(20, k) for k in (1, 2, 3)]
    assert [r.n for r in found] == [3] * 8 + [1] * 3
    assert all((r.whitened is None) == (r.component == 2 or r.vec_id == 20) for r in found)
    assert [r.explained for r in found[:2]] == [pytest.approx(1.0), 0.0] and found[-1].explained is None
    assert found[0].deviation == (3 * 64 - 64 * 7) ** 2 and found[-1].deviation == 0
    assert whitening.whiten(frame(spark, rows).limit(0)).collect() == []
    assert whitening.whiten(frame(spark, bad)).collect() == []


def test_deviations_beyond_a_long_are_null_and_large_ones_exact():
    centre = whitening.Centre.of(3, [2**51, 0])
    x = np.array([[2**51 - 5, 7], [2**20, 2**29]])
    assert centre.deviations(x) == [None, None]
    centre = whitening.Centre.of(3, [3, 3])
    assert centre.deviations(np.array([[2**29, 1], [10**12, 1]])) == [9 * (2**29 - 1) ** 2, None]
