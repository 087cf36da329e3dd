"""False alarms, thresholds, ROC curves, completeness and contrast curves of detection experiments."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import clopper_pearson


def false_alarm_probability(null: DataFrame, stat: str, value: float, confidence: float = 0.95) -> DataFrame:
    """(k + 1) / (n + 1) for k of n nulls at or above the value, with the exact binomial interval of k / n."""
    k, n = null.where(~F.isnan(stat)).agg(F.coalesce(F.sum((F.col(stat) >= value).cast("long")), F.lit(0)), F.count("*")).first()
    low, high = clopper_pearson(k, n, confidence) if n else (0.0, 1.0)
    return null.sparkSession.createDataFrame([(k, n, (k + 1) / (n + 1), low, high)], "k long, n long, fap double, low double, high double")


def threshold(null: DataFrame, stat: str, fap: float, by: list[str] | None = None, n_boot: int = 0, seed: int = 0) -> DataFrame:
    """The exact 1 - fap quantile by group; with n_boot, its error from Poisson bootstrap weights by hash."""
    by = by or []
    out = null.groupBy(*by).agg(F.percentile(stat, 1 - fap).alias("threshold"), F.count("*").alias("n"))
    if not n_boot:
        return out
    draws = null.select(*by, F.col(stat).alias("x"), F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("b"), F.monotonically_increasing_id().alias("i"))
    u = F.pmod(F.xxhash64(F.lit(seed), "b", "i"), F.lit(1 << 30)) / float(1 << 30)
    cuts, total, p = [], 0.0, math.exp(-1)
    for k in range(8):
        total += p / math.factorial(k)
        cuts.append(total)
    weight = sum(((u >= c).cast("int") for c in cuts), F.lit(0))
    boot = draws.withColumn("w", weight).where("w > 0").groupBy(*by, "b").agg(F.percentile("x", 1 - fap, F.col("w")).alias("t"))
    err = boot.groupBy(*by).agg(F.stddev_samp("t").alias("error"))
    return out.join(err, by) if by else out.crossJoin(err)


def roc(rows: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """(threshold, fpr, tpr) at +infinity and every distinct score, downwards.

    Counts are grouped by score before they are summed up, so the running window sees distinct scores only.
    """
    by = by or []
    g = rows.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("q"))
    w = Window.partitionBy(*by).orderBy(F.desc("threshold"))
    run, every = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*by)
    body = g.select(*by, "threshold", (F.sum("q").over(run) / F.sum("q").over(every)).alias("fpr"), (F.sum("p").over(run) / F.sum("p").over(every)).alias("tpr"))
    start = g.select(*by).distinct() if by else g.limit(1).select()
    return start.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")).unionByName(body.withColumn("threshold", F.col("threshold").cast("double")))


def auc(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Trapezoids of tpr over fpr, with no end point added."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(F.desc("threshold"))
    area = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2
    return curve.select(*by, area.alias("a")).groupBy(*by).agg(F.sum("a").alias("auc"))


def detected(score: Column, threshold: Column | float, dx: Column, dy: Column, radius: float) -> Column:
    """Above the threshold and found within the match radius of the truth."""
    return (score > threshold) & (F.hypot(dx, dy) <= radius)


def bin_of(x: Column, edges: list[float]) -> Column:
    """Index of the half-open bin, -1 outside."""
    out = F.lit(-1)
    for i in range(len(edges) - 1):
        out = F.when((x >= edges[i]) & (x < edges[i + 1]), i).otherwise(out)
    return out


def completeness(injected: DataFrame, hit: Column, sep: Column, flux: Column, sep_edges: list[float], flux_edges: list[float]) -> DataFrame:
    """Fraction detected by separation and flux bin."""
    rows = injected.select(bin_of(sep, sep_edges).alias("sep_bin"), bin_of(flux, flux_edges).alias("flux_bin"), hit.cast("double").alias("hit")).where("sep_bin >= 0 and flux_bin >= 0")
    return rows.groupBy("sep_bin", "flux_bin").agg(F.avg("hit").alias("completeness"), F.count("*").alias("n"))


def contrast_curve(table: DataFrame, flux_edges: list[float], target: float = 0.5) -> DataFrame:
    """Per separation the flux at which the running maximum of completeness reaches the target, between log fluxes.

    Null unless two bins bracket the target, or the first reaches it exactly.
    """
    centres = F.array(*(F.lit(math.log(math.sqrt(a * b))) for a, b in zip(flux_edges, flux_edges[1:])))
    w = Window.partitionBy("sep_bin").orderBy("flux_bin")
    run = table.select("sep_bin", "flux_bin", F.element_at(centres, F.col("flux_bin") + 1).alias("x"), F.max("completeness").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("c"))
    run = run.withColumns({"c0": F.lag("c").over(w), "x0": F.lag("x").over(w)})
    cross = F.when((F.col("c") >= target) & (F.col("c0") < target), F.col("x0") + (target - F.col("c0")) / (F.col("c") - F.col("c0")) * (F.col("x") - F.col("x0"))).when(F.col("c0").isNull() & (F.col("c") == target), F.col("x"))
    return run.groupBy("sep_bin").agg(F.exp(F.min(cross)).alias("flux"))


def uniform(*keys) -> Column:
    """A number in [0, 1) from a hash of its keys: the same draw whatever the chunking."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) / float(1 << 52)


def normal(*keys) -> Column:
    """A standard normal number from two hashed uniforms."""
    return F.sqrt(F.log(1.0 - uniform(F.lit(1), *keys)) * -2.0) * F.cos(uniform(F.lit(2), *keys) * (2 * math.pi))


def gaussian_null(samples: DataFrame, prediction: Column, draws: int, seed: int = 0, id: str = "sample_id", error: str = "error", noise: Callable[[Column], Column] | None = None) -> DataFrame:
    """`draws` noisy copies of a prediction on each sample, drawn by (seed, draw, sample), or with `noise(draw)`."""
    out = samples.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return out.withColumn("value", prediction + F.col(error) * (noise(F.col("draw")) if noise else normal(F.lit(seed), "draw", id)))


def sign_flip_null(samples: DataFrame, prediction: Column, draws: int, seed: int = 0, id: str = "sample_id") -> DataFrame:
    """`draws` copies with the sign of each residual drawn anew."""
    out = samples.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    sign = F.when(uniform(F.lit(seed), "draw", id) < 0.5, -1.0).otherwise(1.0)
    return out.withColumn("value", prediction + (F.col("value") - prediction) * sign)


def max_statistics(grid: DataFrame, by: list[str]) -> DataFrame:
    """Per draw: delta chi2 of the best point with flux not below zero, and the largest signal to noise."""
    c, b = F.col("c"), F.col("b")
    gain = F.when((b > 0) & (c > 0), b * b / c).otherwise(0.0)
    return grid.groupBy(*by).agg(F.max(gain).alias("delta_chi2"), F.max(F.when(c > 0, b / F.sqrt(c))).alias("max_snr"))
