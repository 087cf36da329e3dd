"""Orbit searches over epochs: period grids, alias bands, Thiele-Innes least squares, arcs, velocities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.orbits import eccentric_anomaly


def period_grid(spark: SparkSession, span: float, p_min: float, p_max: float, k: float = 9.0) -> DataFrame:
    """(i, period): at least two periods even in 1 / P, so that phases drift by 1 / k of a turn over the span."""
    n = max(2, math.ceil((1 / p_min - 1 / p_max) * k * span) + 1)
    f = (F.col("id") / (n - 1)) * (1 / p_max - 1 / p_min) + 1 / p_min
    return spark.range(n).select(F.col("id").alias("i"), (1.0 / f).alias("period"))


def alias_bands(spark: SparkSession, span: float, p_min: float, p_max: float) -> DataFrame:
    """(n, p_low, p_high): periods with n whole turns over the span, clipped to the range; empty bands left out."""
    first, last = math.floor(span / p_max + 0.5), math.floor(span / p_min + 0.5)
    n = F.col("id").cast("double")
    low = F.greatest(F.lit(span) / (n + 0.5), F.lit(float(p_min)))
    high = F.least(F.when(n == 0, F.lit(float(p_max))).otherwise(F.lit(span) / (n - 0.5)), F.lit(float(p_max)))
    return spark.range(first, last + 1).select(F.col("id").alias("n"), low.alias("p_low"), high.alias("p_high")).where("p_low < p_high")


def alias_bands_of(spans: DataFrame, span: str, p_min: float, p_max: float) -> DataFrame:
    """The bands of `alias_bands` for every row's span: the columns of `spans` with n, p_low and p_high."""
    s = F.col(span).cast("double")
    whole = F.sequence(F.floor(s / p_max + 0.5).cast("long"), F.floor(s / p_min + 0.5).cast("long"))
    rows = spans.where(s > 0).select("*", F.explode(whole).alias("n"))
    n = F.col("n").cast("double")
    low = F.greatest(s / (n + 0.5), F.lit(float(p_min)))
    high = F.least(F.when(n == 0, F.lit(float(p_max))).otherwise(s / (n - 0.5)), F.lit(float(p_max)))
    return rows.withColumns({"p_low": low, "p_high": high}).where("p_low < p_high")


def gram(epochs: DataFrame, grid: DataFrame, dra: str = "dra", ddec: str = "ddec", sigma: str = "sigma", t: str = "mjd") -> DataFrame:
    """Sums that a least-squares fit of A, B, F, G needs for every trial (orbit_id, period, ecc, t_peri).

    Each epoch adds (X, Y) weighted products; north and east share the 2 x 2 matrix. The trials stay, the epochs are
    the small side, and all sums of a trial are made in one fold over the broadcast array of epochs.
    """
    ep = epochs.agg(F.collect_list(F.struct(F.col(t).alias("t"), F.col(dra).alias("x"), F.col(ddec).alias("y"), (1.0 / (F.col(sigma) * F.col(sigma))).alias("w"))).alias("ep"))
    e = F.col("ecc")

    def row(p: Column) -> Column:
        big = eccentric_anomaly((p["t"] - F.col("t_peri")) * (2 * math.pi) / F.col("period"), e)
        return F.struct((F.cos(big) - e).alias("a"), (F.sqrt(1.0 - e * e) * F.sin(big)).alias("b"), p["x"].alias("x"), p["y"].alias("y"), p["w"].alias("w"))

    rows = grid.crossJoin(F.broadcast(ep)).withColumn("rows", F.transform("ep", row)).drop("ep")
    total = lambda f: F.aggregate("rows", F.lit(0.0), lambda s, r: s + r["w"] * f(r))
    sums = {
        "xx": lambda r: r["a"] * r["a"], "xy": lambda r: r["a"] * r["b"], "yy": lambda r: r["b"] * r["b"], "nx": lambda r: r["a"] * r["y"], "ny": lambda r: r["b"] * r["y"],
        "ex": lambda r: r["a"] * r["x"], "ey": lambda r: r["b"] * r["x"], "q": lambda r: r["x"] * r["x"] + r["y"] * r["y"],
    }
    return rows.select(*grid.columns, *(total(f).alias(n) for n, f in sums.items()))


def starting_orbits(epochs: DataFrame, grid: DataFrame, n_best: int = 5, **columns) -> DataFrame:
    """The n_best trials by chi2 with their exact A, B, F, G, from the Gram sums in closed form."""
    g = gram(epochs, grid, **columns)
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    solve = lambda a, b: (((F.col("yy") * F.col(a) - F.col("xy") * F.col(b)) / det), ((F.col("xx") * F.col(b) - F.col("xy") * F.col(a)) / det))
    (A, Fc), (B, G) = solve("nx", "ny"), solve("ex", "ey")
    chi2 = F.col("q") - A * F.col("nx") - Fc * F.col("ny") - B * F.col("ex") - G * F.col("ey")
    fits = g.where(det > 1e-12 * F.col("xx") * F.col("yy")).select(*grid.columns, A.alias("A"), B.alias("B"), Fc.alias("F"), G.alias("G"), chi2.alias("chi2"))
    return fits.orderBy("chi2", "orbit_id").limit(n_best)


def best_per_band(fits: DataFrame, bands: DataFrame, n_best: int = 3) -> DataFrame:
    """The n_best trials of each alias band by chi2."""
    inside = fits.join(F.broadcast(bands), (F.col("period") >= F.col("p_low")) & (F.col("period") < F.col("p_high")))
    w = Window.partitionBy("n").orderBy("chi2", "orbit_id")
    return inside.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_best)


def night_motion(frames: DataFrame, night: str = "night", t: str = "mjd") -> DataFrame:
    """Each night's velocity from the weighted mean positions of its two halves by time."""
    w = Window.partitionBy(night).orderBy(t)
    n = F.count("*").over(Window.partitionBy(night))
    half = F.when(F.row_number().over(w) <= F.floor(n / 2), 0).otherwise(1)
    wt = 1.0 / (F.col("sigma") * F.col("sigma"))
    h = frames.withColumn("half", half).groupBy(night, "half").agg(F.avg(t).alias("t"), (F.sum(wt * F.col("dra")) / F.sum(wt)).alias("x"), (F.sum(wt * F.col("ddec")) / F.sum(wt)).alias("y"), (1.0 / F.sum(wt)).alias("var"))
    pick = lambda c, k: F.max(F.when(F.col("half") == k, F.col(c)))
    p = h.groupBy(night).agg(*(pick(c, k).alias(f"{c}{k}") for c in ("t", "x", "y", "var") for k in (0, 1))).where("t1 > t0")
    dt = F.col("t1") - F.col("t0")
    return p.select(night, ((F.col("t0") + F.col("t1")) / 2).alias("mjd"), ((F.col("x1") - F.col("x0")) / dt).alias("vx"), ((F.col("y1") - F.col("y0")) / dt).alias("vy"), ((F.col("var0") + F.col("var1")) / (dt * dt)).alias("var"))


def position_loglike(epochs: DataFrame, dx: Column, dy: Column, by: list[str]) -> DataFrame:
    """Gaussian log likelihood of 2-D residuals with a covariance struct cov (xx, xy, yy), by orbit."""
    xx, xy, yy = F.col("cov.xx"), F.col("cov.xy"), F.col("cov.yy")
    det = xx * yy - xy * xy
    chi2 = (yy * dx * dx - xy * dx * dy * 2 + xx * dy * dy) / det
    return epochs.groupBy(*by).agg(F.sum(chi2 * -0.5 - F.log(det) * 0.5 - math.log(2 * math.pi)).alias("loglike"))


def rv_marginal_loglike(rows: DataFrame, by: list[str], residual: str, error: str, prior_sd: float | None = None) -> DataFrame:
    """Log likelihood of velocity residuals with one zero point an instrument marginalised, flat or Gaussian, summed."""
    w, r = 1.0 / (F.col(error) * F.col(error)), F.col(residual)
    g = rows.groupBy(*by, "instrument").agg(F.sum(w).alias("w"), F.sum(w * r).alias("wr"), F.sum(w * r * r).alias("wrr"), F.sum(F.log(w)).alias("lw"), F.count("*").alias("n"))
    p = F.col("w") + (1 / prior_sd**2 if prior_sd else 0.0)
    ll = (F.col("wrr") - F.col("wr") * F.col("wr") / p) * -0.5 + F.col("lw") * 0.5 - F.col("n") * (0.5 * math.log(2 * math.pi)) - F.log(p) * 0.5
    ll = ll + (0.5 * math.log(2 * math.pi) if not prior_sd else -math.log(prior_sd))
    return g.groupBy(*by).agg(F.sum(ll).alias("loglike"))


def scale_marginal(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Log likelihood up to a constant with each block's error scale marginalised: -sum nu / 2 ln chi2."""
    return blocks.groupBy(*by).agg(F.sum(F.col("nu") * F.log("chi2") * -0.5).alias("score"))


def distinct_tracks(tracks: pd.DataFrame, min_distance: float, n: int) -> list[int]:
    """Greedy choice of rows (one track each, best first) that are all further apart in rms than min_distance."""
    kept: list[int] = []
    values = tracks.to_numpy(float)
    for i in range(len(values)):
        if all(np.sqrt(np.mean((values[i] - values[j]) ** 2)) > min_distance for j in kept):
            kept.append(i)
        if len(kept) == n:
            break
    return kept
