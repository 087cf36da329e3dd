"""Grouped statistics: profiles, quantiles, image metrics, cross-validation, tempering, noise scales."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import floor_mod


def radial_profile(df: DataFrame, value: str, r: Column, r_max: float, bins: int = 20) -> DataFrame:
    """One row per annulus of [0, r_max]: mean, std (of the population), median, q16, q84 and count of finite values.

    Annuli are half open but the last; empty ones are there with null statistics and count 0.
    """
    spark = df.sparkSession
    at = F.when(r == r_max, bins - 1).otherwise(F.floor(r / r_max * bins)).cast("int")
    fine = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")) & (r >= 0) & (r <= r_max)).select(at.alias("bin"), F.col(value).alias("x"))
    stats = fine.groupBy("bin").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("*").alias("n"))
    # equal values are counted first, so that what a group gathers is its distinct values, once for all quantiles
    counts = fine.groupBy("bin", "x").agg(F.count("*").alias("c"))
    found = counts.groupBy(F.col("bin").alias("__bin")).agg(F.percentile("x", [0.5, 0.16, 0.84], F.col("c")).alias("q"))
    stats = stats.join(found, F.col("bin") == F.col("__bin")).select("bin", "mean", "std", "n", *(F.col("q")[i].alias(k) for i, k in enumerate(("median", "q16", "q84"))))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(stats, "bin", "left").select("bin", ((F.col("bin") + 0.5) * (r_max / bins)).alias("radius"), "mean", "std", "median", "q16", "q84", F.coalesce("n", F.lit(0)).alias("n"))


def weighted_quantile(df: DataFrame, by: list[str], value: str, weight: str, q: float = 0.5) -> DataFrame:
    """The first value at which the running weight reaches q of the whole, by group."""
    order = Window.partitionBy(*by).orderBy(value)
    run = F.sum(weight).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum(weight).over(Window.partitionBy(*by))
    return df.select(*by, F.col(value).alias("v"), run.alias("run"), total.alias("total")).where(F.col("run") >= F.col("total") * q).groupBy(*by).agg(F.min("v").alias("quantile"))


def l1_score(df: DataFrame, by: list[str], image: str, truth: str) -> DataFrame:
    """1 - sum |a e - r| / sum r, with a the e-weighted median of r / e; negative e count as 0."""
    e = F.greatest(F.col(image), F.lit(0.0))
    rows = df.select(*by, e.alias("e"), F.col(truth).alias("r"))
    a = weighted_quantile(rows.where("e > 0").withColumn("ratio", F.col("r") / F.col("e")), by, "ratio", "e")
    return rows.join(a, by).groupBy(*by).agg((1.0 - F.sum(F.abs(F.col("quantile") * F.col("e") - F.col("r"))) / F.sum("r")).alias("l1_score"))


def image_metrics(df: DataFrame, by: list[str], image: str, truth: str) -> DataFrame:
    """ncc, rms and the flux-weighted rms over the peak, of unit-sum images."""
    total = Window.partitionBy(*by)
    unit = df.select(*by, (F.col(image) / F.sum(image).over(total)).alias("e"), (F.col(truth) / F.sum(truth).over(total)).alias("r"))
    d = F.col("e") - F.col("r")
    return unit.groupBy(*by).agg(F.corr("e", "r").alias("ncc"), F.sqrt(F.avg(d * d)).alias("rms"), (F.sqrt(F.sum(F.col("r") * d * d) / F.sum("r")) / F.max("r")).alias("lawson"))


def mad_cut(df: DataFrame, by: list[str], value: str, cut: float = 5.0) -> DataFrame:
    """Rows at most `cut` scaled median absolute deviations above their group's median; all, if that deviation is 0."""
    mid = df.groupBy(*by).agg(F.median(value).alias("__mid"))
    with_mid = df.join(mid, by)
    spread = with_mid.groupBy(*by).agg((F.median(F.abs(F.col(value) - F.col("__mid"))) * 1.4826).alias("__mad"))
    return with_mid.join(spread, by).where((F.col("__mad") <= 0) | (F.col(value) <= F.col("__mid") + F.col("__mad") * cut)).drop("__mid", "__mad")


def logsumexp(df: DataFrame, by: list[str], x: str, weight: Column | None = None, mean: bool = False) -> DataFrame:
    """log of the sum (or mean) of w exp(x) by group, in one aggregate of pairs merged by their maximum's scale."""
    top = df.groupBy(*by).agg(F.max(x).alias("__m"))
    e = F.exp(F.col(x) - F.col("__m")) * (1.0 if weight is None else weight)
    return df.join(top, by).groupBy(*by).agg((F.first("__m") + F.log(F.avg(e) if mean else F.sum(e))).alias("logsumexp"))


def circular_quantiles(df: DataFrame, by: list[str], angle: str, qs=(0.16, 0.5, 0.84), period: float = 360.0) -> DataFrame:
    """Quantiles of deviations from the mean direction, put back on the circle."""
    turn = 2 * math.pi / period
    t = F.col(angle) * turn
    mean = df.groupBy(*by).agg(F.atan2(F.avg(F.sin(t)), F.avg(F.cos(t))).alias("__mean"))
    dev = floor_mod(t - F.col("__mean") + math.pi, 2 * math.pi) - math.pi
    out = df.join(mean, by).select(*by, "__mean", dev.alias("__dev"))
    return out.groupBy(*by).agg(*(floor_mod((F.first("__mean") + F.percentile("__dev", q)) / turn, period).alias(f"q{round(100 * q)}") for q in qs))


def cv_curve(records: DataFrame, larger_is_simpler: bool = True) -> DataFrame:
    """One row per setting of (setting, fold, score): mean, sd, se, and whether it is best, one-SE choice, at an edge.

    The best is the least mean; the one-SE choice the simplest setting whose mean is at most the best plus its se.
    Settings whose folds are not all there, or double, have `complete` false and no part in either.
    """
    folds = records.agg(F.count_distinct("fold").alias("__folds"))
    c = records.groupBy("setting").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.count("*").alias("n"), F.count_distinct("fold").alias("d"))
    c = c.crossJoin(F.broadcast(folds)).select("setting", "mean", "sd", (F.col("sd") / F.sqrt("n")).alias("se"), ((F.col("n") == F.col("__folds")) & (F.col("d") == F.col("__folds"))).alias("complete"))
    good = c.where(F.col("complete") & ~F.isnan("mean"))
    best = good.agg(F.min_by(F.struct("setting", "mean", "se"), F.struct("mean", "setting")).alias("b")).select("b.*").toDF("__best", "__mean", "__se")
    near = good.crossJoin(F.broadcast(best)).where(F.col("mean") <= F.col("__mean") + F.col("__se"))
    one = near.agg((F.max("setting") if larger_is_simpler else F.min("setting")).alias("__one"))
    ends = c.agg(F.min("setting").alias("__lo"), F.max("setting").alias("__hi"))
    out = c.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(one)).crossJoin(F.broadcast(ends))
    return out.select("setting", "mean", "sd", "se", "complete", (F.col("setting") == F.col("__best")).alias("best"), (F.col("setting") == F.col("__one")).alias("one_se"), F.col("__best").isin(F.col("__lo"), F.col("__hi")).alias("edge"))


def tempering_factors(residuals: DataFrame, least_chains: int = 10) -> DataFrame:
    """(block, f, chains, pooled): sum over chains of (sum z)^2 over sum z^2, at least 1; few chains take the pooled one."""
    chains = residuals.groupBy("block", "chain").agg(F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q"))
    s2 = F.col("s") * F.col("s")
    blocks = chains.groupBy("block").agg(F.sum(s2).alias("a"), F.sum("q").alias("b"), F.count("*").alias("chains"))
    pooled = chains.agg((F.sum(s2) / F.sum("q")).alias("__p"))
    few = F.col("chains") < least_chains
    return blocks.crossJoin(F.broadcast(pooled)).select("block", F.greatest(F.lit(1.0), F.when(few, F.col("__p")).otherwise(F.col("a") / F.col("b"))).alias("f"), "chains", few.alias("pooled"))


def sigma_scale(points: DataFrame, levels: tuple[str, ...] = ("ddid", "obs")) -> DataFrame:
    """Error scale from differences of neighbours in time, per ddid, per obs and over all in one GROUPING SETS pass.

    Pairs are (0, 1), (2, 3), ... of a run of one scan, baseline, frequency and ddid; z = difference^2 / (1/w + 1/w').
    """
    run = Window.partitionBy("scan", "ant1", "ant2", "freq", "ddid").orderBy("time", "point_id")
    nxt = lambda c: F.lead(c).over(run)
    var = 1.0 / F.col("weight") + 1.0 / nxt("weight")
    z = ((F.col("re") - nxt("re")) ** 2 / var + (F.col("im") - nxt("im")) ** 2 / var) / 2
    pairs = points.select(*levels, z.alias("z"), F.row_number().over(run).alias("rn")).where("rn % 2 = 1 and z is not null")
    cube = pairs.groupingSets([[F.col(x)] for x in levels] + [[]], *levels)
    out = cube.agg(F.avg("z").alias("m"), F.avg(F.col("z") * F.col("z")).alias("m2"), F.count("*").alias("pairs"))
    s = F.sqrt("m")
    return out.select(*levels, s.alias("scale"), (F.sqrt(F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(0.0)) / F.col("pairs")) / (s * 2)).alias("se"), "pairs")


def phase_unwrap(df: DataFrame, by: list[str], order: str, phase: str) -> DataFrame:
    """Add unwrapped: the running sum of steps wrapped to [-pi, pi) from the first phase."""
    w = Window.partitionBy(*by).orderBy(order)
    step = F.col(phase) - F.lag(phase).over(w)
    wrapped = F.coalesce(floor_mod(step + math.pi, 2 * math.pi) - math.pi, F.col(phase))
    return df.withColumn("__s", wrapped).withColumn("unwrapped", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__s")


def continuum_normalise(df: DataFrame, by: list[str], value: str, wavel: str, continuum: Column) -> DataFrame:
    """Add normalised: value over a straight line in 1 / wavelength fitted to the continuum channels of each row."""
    g = Window.partitionBy(*by)
    x, y = 1.0 / F.col(wavel), F.col(value)
    pick = lambda c: F.sum(F.when(continuum, c)).over(g)
    n, mx, my = pick(F.lit(1.0)), pick(x) / pick(F.lit(1.0)), pick(y) / pick(F.lit(1.0))
    out = df.withColumns({"__mx": mx, "__my": my})
    dx, dy = x - F.col("__mx"), y - F.col("__my")
    slope = F.sum(F.when(continuum, dx * dy)).over(g) / F.nullif(F.sum(F.when(continuum, dx * dx)).over(g), F.lit(0.0))
    return out.withColumn("normalised", y / (F.col("__my") + F.coalesce(slope, F.lit(0.0)) * dx)).drop("__mx", "__my")


def channel_chains(df: DataFrame, by: list[str], wavel: str, id: str) -> DataFrame:
    """(chain by `by`, k, id) of groups with two or more strictly increasing wavelengths."""
    w = Window.partitionBy(*by).orderBy(wavel, id)
    one = df.withColumn("__first", F.row_number().over(Window.partitionBy(*by, wavel).orderBy(id))).where("__first = 1").drop("__first")
    return one.withColumn("k", F.row_number().over(w) - 1).withColumn("length", F.count("*").over(Window.partitionBy(*by))).where("length >= 2")


def outlier_mixture(loglikes: DataFrame, by: list[str], groups: int, inlier: str = "ll", outlier: str = "ll_out") -> DataFrame:
    """log of the mean over groups + 1 nodes of the product over groups of (1 - eps) L + eps B."""
    n = groups + 1
    nodes = F.explode(F.array(*(F.lit(0.5 * (1 - math.cos((2 * j - 1) * math.pi / (2 * n)))) for j in range(1, n + 1))))
    top = F.greatest(F.col(inlier), F.col(outlier))
    one = top + F.log((1.0 - F.col("eps")) * F.exp(F.col(inlier) - top) + F.col("eps") * F.exp(F.col(outlier) - top))
    per = loglikes.withColumn("eps", nodes).groupBy(*by, "eps").agg(F.sum(one).alias("t"))
    return logsumexp(per, by, "t", mean=True).withColumnRenamed("logsumexp", "log_mixture")


def outlier_probabilities(loglikes: DataFrame, by: list[str], group: str, groups: int, inlier: str = "ll", outlier: str = "ll_out") -> DataFrame:
    """(by, group, probability): posterior of each group being an outlier, the rate marginalised as in outlier_mixture."""
    n = groups + 1
    nodes = F.explode(F.array(*(F.lit(0.5 * (1 - math.cos((2 * j - 1) * math.pi / (2 * n)))) for j in range(1, n + 1))))
    top = F.greatest(F.col(inlier), F.col(outlier))
    one = top + F.log((1.0 - F.col("eps")) * F.exp(F.col(inlier) - top) + F.col("eps") * F.exp(F.col(outlier) - top))
    rows = loglikes.withColumn("eps", nodes).withColumn("term", one)
    totals = rows.groupBy(*by, "eps").agg(F.sum("term").alias("t"))
    best = totals.groupBy(*by).agg(F.max("t").alias("most"))
    weights = totals.join(best, by).select(*by, "eps", F.exp(F.col("t") - F.col("most")).alias("w"))
    share = F.exp(F.log("eps") + F.col(outlier) - F.col("term"))
    return rows.join(weights, [*by, "eps"]).groupBy(*by, group).agg((F.sum(F.col("w") * share) / F.sum("w")).alias("probability"))


def predictive_summary(predictions: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mean, spread) of a model observable over posterior draws."""
    return predictions.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"))


def chi2_by(points: DataFrame, by: list[str], value: str, model: Column, error: str) -> DataFrame:
    """(by, chi2, n) of whitened residuals."""
    return points.groupBy(*by).agg(F.sum(F.pow((model - F.col(value)) / F.col(error), 2.0)).alias("chi2"), F.count("*").alias("n"))


def reason_counts(members: DataFrame, reason: str = "reason") -> DataFrame:
    """(reason, members) of an ensemble."""
    return members.groupBy(reason).agg(F.count("*").alias("members"))
