"""Injected companions and their recovery: one pass over the samples for all draws, positions and fluxes.

With squared visibilities the chi-square of a companion at a position is a polynomial in its flux, whose sums are of
three kinds: of the position alone, of the draw alone, and of both. The last are a product of two matrices, positions by
samples and samples by draws, which every task makes of its rows; all fluxes share them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import MAS
from ..functions.photometry import observable
from ..operators.detection import normal, uniform
from .models import Component, samples_uv

#: Draws whose data a task holds at once, and positions of the search.
DRAWS, POSITIONS = 4096, 1 << 14


def injection_grid(spark: SparkSession, separations: list[float], fluxes: list[float], n_pa: int, seed: int = 0) -> DataFrame:
    """(draw, dra, ddec, flux): every separation and flux at `n_pa` position angles drawn by a hash, in this order."""
    if n_pa < 1 or min([0.0, *separations, *fluxes]) < 0:
        raise ValueError("n_pa must be positive, separations and fluxes not negative")
    pick = lambda values, at: F.element_at(F.array(*(F.lit(float(x)) for x in values)), (at + 1).cast("int"))
    d = F.col("id")
    sep, flux = pick(separations, F.floor(d / (len(fluxes) * n_pa))), pick(fluxes, F.floor(d / n_pa) % len(fluxes))
    angle = uniform(F.lit(seed), d) * (2 * math.pi)
    return spark.range(len(separations) * len(fluxes) * n_pa).select(d.alias("draw"), (sep * F.sin(angle)).alias("dra"), (sep * F.cos(angle)).alias("ddec"), flux.alias("flux"))


def rescale_errors(samples: DataFrame, null: Component, kind: str = "v2") -> tuple[DataFrame, float]:
    """The samples with errors times the root of the null's chi-square a sample, and that factor."""
    r = (observable(null.cvis(samples_uv()), kind) - F.col("value")) / F.col("error")
    mean = samples.agg(F.avg(r * r)).first()[0]
    if mean is None or not 0 < mean < math.inf:
        raise ValueError("the null fits the data perfectly or not at all")
    return samples.withColumn("error", F.col("error") * math.sqrt(mean)), math.sqrt(mean)


def _sums(positions: np.ndarray):
    """(row, column, value): Gram sums of features of positions, of draws, and of both, by task.

    Per sample and position x = Re of the companion's phase; per sample and draw d; w = 1 / error^2. Rows 0 to P - 1 are
    positions and hold sum w x d; row -1 sum w d, row -2 sum w d^2; column -1 and -2 sum w x and sum w x^2; (-1, -1) sum w.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            u, v, w = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("__u", "__v", "__w"))
            lists = b.column("__draws")
            d = np.asarray(lists.flatten()).reshape(b.num_rows, -1)
            x = np.cos(2 * np.pi * MAS * (np.outer(u, positions[:, 0]) + np.outer(v, positions[:, 1])))
            left, right = np.hstack([x, np.ones((len(u), 1)), x * x]), np.hstack([d, np.ones((len(u), 1)), d * d])
            p, n = x.shape[1], d.shape[1]
            wide = np.zeros((p + 2, n + 2))
            both = (left[:, : p + 1] * w[:, None]).T @ right[:, : n + 1]
            wide[: p + 1, : n + 1] = both
            wide[:p, n + 1] = w @ left[:, p + 1 :]
            wide[p + 1, :n] = w @ right[:, n + 1 :]
            total = wide if total is None else total + wide
        if total is not None:
            rows, columns = total.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(rows), columns).astype(np.int32)), pa.array(np.tile(np.arange(columns), rows).astype(np.int32)), pa.array(total.ravel())], ["p", "d", "v"])

    return task


def search(samples: DataFrame, draws: Column, n_draws: int, positions: DataFrame, fluxes: list[float]) -> DataFrame:
    """(draw, delta_chi2, point_id, dra, ddec, flux, snr) of the best position and flux for every draw's data.

    `draws` is an array of `n_draws` squared visibilities a sample, of a star without and with companions; positions
    (point_id, dra, ddec) are at most POSITIONS. A draw for which no companion improves the fit has delta_chi2 0 and no
    position. snr is the largest over positions of the flux that is best to first order, over its error.
    """
    if n_draws > DRAWS:
        raise ValueError(f"search {DRAWS} draws at a time")
    held = positions.select("point_id", "dra", "ddec").orderBy("point_id").limit(POSITIONS + 1).collect()
    if len(held) > POSITIONS:
        raise ValueError(f"a search has at most {POSITIONS} positions")
    at = np.array([(r["dra"], r["ddec"]) for r in held], float).reshape(-1, 2)
    wavel = F.col("wavel")
    # names of their own, as a name inside a lambda would be taken for an alias of the same list
    rows = samples.select((F.col("u") / wavel).alias("__u"), (F.col("v") / wavel).alias("__v"), (1.0 / (F.col("error") * F.col("error"))).alias("__w"), draws.alias("__draws"))
    sums = rows.mapInArrow(_sums(at), "p int, d int, v double").groupBy("p", "d").agg(F.sum("v").alias("v"))
    n_p = len(held)
    # one row for each draw and position with the sums it shares with its draw, its position, and all
    cross = sums.where(f"p < {n_p} and d < {n_draws}").withColumnRenamed("v", "wxd")
    of_draw = sums.where(f"p >= {n_p} and d < {n_draws}").groupBy("d").agg(F.sum(F.when(F.col("p") == n_p, F.col("v"))).alias("wd"), F.sum(F.when(F.col("p") == n_p + 1, F.col("v"))).alias("wdd"))
    of_point = sums.where(f"p < {n_p} and d >= {n_draws}").groupBy("p").agg(F.sum(F.when(F.col("d") == n_draws, F.col("v"))).alias("wx"), F.sum(F.when(F.col("d") == n_draws + 1, F.col("v"))).alias("wxx"))
    whole = sums.where(f"p = {n_p} and d = {n_draws}").select(F.col("v").alias("w"))
    spots = samples.sparkSession.createDataFrame([(i, r["point_id"], float(r["dra"]), float(r["ddec"])) for i, r in enumerate(held)], "p int, point_id long, dra double, ddec double")
    both = cross.join(of_draw, "d").join(F.broadcast(of_point), "p").join(F.broadcast(spots), "p").crossJoin(F.broadcast(whole))
    w, wd, wdd, wx, wxx, wxd = (F.col(c) for c in ("w", "wd", "wdd", "wx", "wxx", "wxd"))
    # residual times (1 + f)^2 is a (1 + f^2) + 2 b f with a = 1 - d and b = x - d
    aa, ab, bb = w - wd * 2.0 + wdd, wx - wxd - wd + wdd, wxx - wxd * 2.0 + wdd
    ladder = F.array(*(F.lit(float(f)) for f in fluxes))
    chi2 = lambda f: (aa * F.pow(f * f + 1.0, 2.0) + ab * 4.0 * f * (f * f + 1.0) + bb * 4.0 * f * f) / F.pow(f + 1.0, 4.0)
    gains = F.transform(ladder, lambda f: F.struct((aa - chi2(f)).alias("gain"), f.alias("flux")))
    best = F.array_max(gains)
    # to first order the visibility rises by 2 (x - 1) f: its sum against the residual, and its own square
    slope, square = (wxd - wx - wd + w) * 2.0, (wxx - wx * 2.0 + w) * 4.0
    each = both.select(F.col("d").alias("draw"), "point_id", "dra", "ddec", best["gain"].alias("gain"), best["flux"].alias("flux"), F.when(square > 0, slope / F.sqrt(square)).alias("snr"))
    top = each.groupBy("draw").agg(F.max_by(F.struct("gain", "flux", "point_id", "dra", "ddec"), F.struct(F.col("gain"), -F.col("point_id"))).alias("top"), F.max("snr").alias("snr"))
    found = F.col("top.gain") > 0
    shown = [F.when(found, F.col(f"top.{c}")).alias(c) for c in ("point_id", "dra", "ddec")]
    return top.select(F.col("draw").cast("long").alias("draw"), F.when(found, F.col("top.gain")).otherwise(0.0).alias("delta_chi2"), *shown, F.when(found, F.col("top.flux")).alias("flux"), "snr")


def recovery(samples: DataFrame, injections: DataFrame, n_null: int, positions: DataFrame, fluxes: list[float], seed: int = 0, noise: Callable[[Column], Column] | None = None, match_radius: float | None = None, id: str = "sample_id") -> DataFrame:
    """Simulated observations of a star searched for companions: a row for each null and injected draw.

    Draws 0 to n_null - 1 are of the star alone, the others of it with the companions of `injections` (draw from 0, dra,
    ddec, flux). Each sample's noise is normal of its error, by a hash of (seed, draw, sample), or `noise(draw)`. Columns
    are those of `search`, and true_dra, true_ddec, true_flux (null for nulls) and `hit`: found at the injected place or
    at its reflection, which squared visibilities cannot tell from it, within `match_radius` if it is given.
    """
    planted = injections.select("draw", "dra", "ddec", "flux").orderBy("draw").collect()
    total, wavel = n_null + len(planted), F.col("wavel")
    drawn = noise or (lambda k: normal(F.lit(seed), k.cast("long"), id))
    if not total:
        raise ValueError("there is nothing to draw")

    def value(k: Column, x: Column, y: Column, f: Column) -> Column:
        c = F.cos((F.col("u") / wavel * x + F.col("v") / wavel * y) * (2 * math.pi * MAS))
        return (f * f + c * f * 2.0 + 1.0) / F.pow(f + 1.0, 2.0) + F.col("error") * drawn(k)

    truth = [(k, None, None, None) for k in range(n_null)] + [(n_null + i, float(r["dra"]), float(r["ddec"]), float(r["flux"])) for i, r in enumerate(planted)]
    spec = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(x or 0.0).alias("x"), F.lit(y or 0.0).alias("y"), F.lit(f or 0.0).alias("f")) for k, x, y, f in truth))
    found = search(samples, F.transform(spec, lambda r: value(r["k"], r["x"], r["y"], r["f"])), total, positions, fluxes)
    table = samples.sparkSession.createDataFrame(truth, "draw long, true_dra double, true_ddec double, true_flux double")
    out = found.join(F.broadcast(table), "draw")
    apart = lambda sign: F.hypot(F.col("dra") - F.col("true_dra") * sign, F.col("ddec") - F.col("true_ddec") * sign)
    off = F.least(apart(1.0), apart(-1.0))
    near = off <= match_radius if match_radius is not None else F.lit(True)
    return out.withColumn("hit", F.coalesce((F.col("delta_chi2") > 0) & F.col("true_flux").isNotNull() & near, F.lit(False)))
