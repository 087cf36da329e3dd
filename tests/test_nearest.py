"""The nearest row in time against every pair, and a crowded moment without pairs."""

import numpy as np
from pyspark.sql import functions as F

from fringelake.operators import joins


def test_nearest_equals_every_pair(spark):
    rng = np.random.default_rng(0)
    left = [(i, int(k) if k < 4 else None, float(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 5, 200), rng.integers(0, 60, 200) / 7))] + [(900, 1, None)]
    right = [(i, int(k) if k < 4 else None, float(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 5, 150), rng.integers(0, 60, 150) / 7))]
    a = spark.createDataFrame(left, "left_id long, k int, lt double").repartition(3)
    b = spark.createDataFrame(right, "right_id long, k int, rt double").repartition(2)
    for tolerance in (0.15, 0.3, 2.0):
        found = {r.left_id: (r.right_id, r.distance) for r in joins.nearest(a, b, ["k"], "lt", "rt", tolerance, "right_id").collect()}
        assert len(found) == 201
        for i, k, t in left:
            near = [(abs(t - s), j) for j, q, s in right if k is not None and t is not None and q == k and abs(t - s) <= tolerance]
            want = min(near) if near else (None, None)
            assert found[i] == (want[1], want[0])


def test_a_crowded_moment_makes_no_pairs(spark):
    """20,000 rows of each side in one bin would be 400 million pairs."""
    rows = spark.range(20_000).withColumn("k", F.lit(1))
    a = rows.select(F.col("id").alias("left_id"), "k", (F.col("id") * 1e-6).alias("lt"))
    b = rows.select(F.col("id").alias("right_id"), "k", (F.col("id") * 1e-6 + 2e-7).alias("rt"))
    found = joins.nearest(a, b, ["k"], "lt", "rt", 1.0, "right_id")
    assert found.where("right_id = left_id").count() == 20_000
