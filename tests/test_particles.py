"""Resampling against counts worked out from the weights, and Monte Carlo against closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.plans import particles


def test_draws_follow_the_weights(spark, monkeypatch):
    monkeypatch.setattr(particles, "SLICE", 7)
    rng = np.random.default_rng(0)
    w = np.append(rng.exponential(size=60) ** 3, [0.0, 5.0, 5.0])
    rows = [(i, float(np.log(x)) if x else -math.inf) for i, x in enumerate(w)] + [(90, None), (91, math.nan)]
    df = spark.createDataFrame(rows, "particle long, lw double").repartition(4)
    for n in (1, 10, 1000):
        found = {r.particle: (r.draws, r.first) for r in particles.resample(df, "lw", n, seed=3).collect()}
        assert len(found) == 65 and sum(d for d, _ in found.values()) == n
        assert found[60][0] == found[90][0] == found[91][0] == 0
        for i, x in enumerate(w):
            assert abs(found[i][0] - n * x / w.sum()) < 1 + 1e-6
        again = particles.resample(df.repartition(2), "lw", n, seed=3)
        assert {r.particle: (r.draws, r.first) for r in again.collect()} == found
        draws = particles.drawn(again).orderBy("particle").collect()
        assert [r.particle for r in draws] == list(range(n))
    with pytest.raises(ValueError, match="weight"):
        particles.resample(df.where("particle = 60"), "lw", 5)


def test_a_million_particles(spark):
    df = spark.range(1_000_000).select(F.col("id").alias("particle"), F.log(F.col("id") % 10 + 1.0).alias("lw"))
    found = particles.resample(df, "lw", 1_000_000, seed=1)
    sums = {r.k: r.d for r in found.groupBy((F.col("particle") % 10).alias("k")).agg(F.sum("draws").alias("d")).collect()}
    assert sum(sums.values()) == 1_000_000
    assert sums == {k: pytest.approx((k + 1) / 55 * 1e6, rel=0.01) for k in range(10)}
    assert found.agg(F.max("draws")).first()[0] <= 2


def gaussian(points):
    """Start: nothing known. End: a normal about (1, -1) of width 0.2 and 0.5, correlated."""
    x, y = (F.col("x") - 1.0) / 0.2, (F.col("y") + 1.0) / 0.5
    return points.select("particle", F.lit(0.0).alias("start"), ((x * x - x * y + y * y) * -0.5).alias("end"))


def test_evidence_and_moments_of_a_gaussian(spark):
    n = 4000
    u = lambda k: (particles.uniform(F.lit(k), "particle") - 0.5) * 10
    prior = spark.range(n).withColumnRenamed("id", "particle").withColumns({"x": u(1), "y": u(2)}).repartition(4)
    box = F.when((F.abs("x") < 5) & (F.abs("y") < 5), 0.0).otherwise(-math.inf)
    found = particles.bridge(prior, ["x", "y"], box, gaussian, moves=3, seed=2)
    # the integral over the plane: 2 pi 0.2 0.5 / sqrt(1 - 1/4), of a box of area 100
    assert found.log_evidence == pytest.approx(math.log(2 * math.pi * 0.1 / math.sqrt(0.75) / 100), abs=0.15)
    r = found.df.agg(F.avg("x"), F.avg("y"), F.stddev("x"), F.stddev("y"), F.corr("x", "y"), F.count("*")).first()
    assert r[5] == n and r[:5] == pytest.approx((1, -1, 0.2 / math.sqrt(0.75), 0.5 / math.sqrt(0.75), 0.5), abs=0.06)
    assert [s["beta"] for s in found.steps] == sorted(s["beta"] for s in found.steps) and found.steps[-1]["beta"] == 1
    assert all(0.05 < s["accepted"] < 0.95 for s in found.steps)
