"""The quantiles of a radial profile gather counted values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.operators import stats


def test_quantiles_gather_each_value_of_an_annulus_once(spark):
    df = spark.range(20_000).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 10).cast("double").alias("r"))
    out = stats.radial_profile(df, "x", F.col("r"), 10.0, 5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    gathers = [line for line in plan.splitlines() if "percentile(x" in line]
    assert len(gathers) == 1 and gathers[0].count("percentile(x") == 1
    rows = df.toPandas()
    for r in out.collect():
        x = rows.x[(rows.r // 2) == r.bin]
        assert (r.n, r["median"], r.q16, r.q84) == (len(x), *np.quantile(x, [0.5, 0.16, 0.84]))
        assert (r["mean"], r["std"]) == pytest.approx((x.mean(), x.std(ddof=0)))
