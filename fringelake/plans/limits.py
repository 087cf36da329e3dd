"""Contrast limits: the flux at which a companion is excluded, or would be detected, at a significance.

The chi-square of a trial is held against that of no companion, and the ratio that a significance asks for is solved
once. Brackets of the flux are a table with a row for each position. Every round evaluates all positions that are still
open in one aggregate over the samples, at several trial fluxes each, and closes those that are done, so that the table
shrinks and a step costs one pass whatever the number of positions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.photometry import observable
from . import grid
from .models import Component, samples_uv
from .work import Table

#: The search goes up by quarters of a decade and then halves the step that crosses so many times.
STEP, BISECTIONS = 0.25, 22
#: Trial fluxes of a position in a round: rungs of the ladder, and halvings decided at once (2^n - 1 trials).
RUNGS, HALVINGS = 8, 3


def ratio_of(sigma: float, ndof: int) -> float:
    """The ratio of chi-squares whose significance is `sigma`: the inverse of `special.nsigma`."""
    floor, ceiling = (float(special.nsigma_values(np.array([x]), np.array([1.0]), ndof)[0]) for x in (1.0, 1e300))
    if not floor < sigma < ceiling:
        raise ValueError(f"sigma must lie between {floor:.3g}, that of a ratio of 1 over {ndof} degrees of freedom, and {ceiling:.3g}")
    low, high = 1.0, 2.0
    above = lambda q: float(special.nsigma_values(np.array([q]), np.array([1.0]), ndof)[0]) >= sigma
    while not above(high):
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if above(mid) else (mid, high)
    return high


def merged(samples: DataFrame) -> DataFrame:
    """(u, v, wavel, value, error, rest, n): samples of one baseline and wavelength as their weighted mean.

    A Gaussian likelihood depends on them through the mean, its error, and `rest`, the chi-square about the mean.
    """
    w = 1.0 / (F.col("error") * F.col("error"))
    out = samples.groupBy("u", "v", "wavel").agg(F.sum(w).alias("w"), (F.sum(w * F.col("value")) / F.sum(w)).alias("value"), F.sum(w * F.col("value") * F.col("value")).alias("square"), F.count("*").alias("n"))
    rest = F.greatest(F.col("square") - F.col("w") * F.col("value") * F.col("value"), F.lit(0.0))
    return out.select("u", "v", "wavel", "value", (1.0 / F.sqrt("w")).alias("error"), rest.alias("rest"), "n")


def _ladder(low: float, high: float) -> list[float]:
    """Log fluxes from low upwards by STEP, the last step cut at high."""
    a, b = math.log10(low), math.log10(high)
    return [min(a + k * STEP, b) for k in range(math.ceil((b - a) / STEP - 1e-12) + 1)]


def solve(cells: DataFrame, evaluate: Callable[[DataFrame, int], DataFrame], bounds: tuple[float, float] = (1e-6, 1.0), bisections: int = BISECTIONS, flux: str = "flux") -> DataFrame:
    """`cells` (point_id, ...) with log_limit, limit and side, by rounds over a shrinking table of brackets.

    `evaluate(trials, n)` takes n trials (the columns of cells, `flux` and __k) and gives (point_id, __k, reached). The
    limit is the first crossing on the way up, halved `bisections` times: `side` is crossed. A position that is reached
    at the lower bound is `below`, one that is not reached anywhere `above`; their limit is null, and log_limit the bound.
    """
    columns = cells.columns
    if not (0 < bounds[0] < bounds[1] < math.inf):
        raise ValueError("bounds must be finite with 0 < low < high")

    def trials(open_cells: DataFrame, at: Column) -> DataFrame:
        return open_cells.select(*columns, F.posexplode(at).alias("__k", "__log")).withColumn(flux, F.pow(F.lit(10.0), F.col("__log")))

    def flags(open_cells: DataFrame, at: Column, n: int) -> DataFrame:
        """The open cells with the sorted flags of their trials."""
        ordered = F.sort_array(F.collect_list(F.struct("__k", "reached")))
        hit = evaluate(trials(open_cells, at), n).groupBy("point_id").agg(F.transform(ordered, lambda h: h["reached"]).alias("__hit"))
        return open_cells.join(hit, "point_id")

    ladder = _ladder(*bounds)
    work, n, done = Table(cells.select(*columns), "limits"), cells.count(), []
    tables = [work]
    for start in range(0, len(ladder), RUNGS):
        rungs = ladder[start : start + RUNGS]
        if not n:
            break
        at = F.array(*(F.lit(x) for x in rungs))
        seen = flags(work.df, at, n * len(rungs))
        # how many rungs from the first are not reached
        below = F.coalesce(F.array_position("__hit", F.lit(True)) - 1, F.lit(0))
        below = F.when(F.array_contains("__hit", F.lit(True)), below).otherwise(len(rungs)) + start
        seen = Table(seen.select(*columns, below.cast("int").alias("__rung")), "limits")
        tables.append(seen)
        done.append(seen.df.where(F.col("__rung") < min(start + RUNGS, len(ladder))))
        work = Table(seen.df.where(F.col("__rung") >= min(start + RUNGS, len(ladder))).select(*columns), "limits")
        tables.append(work)
        n = work.df.count()
    never = work.df.withColumn("__rung", F.lit(len(ladder)))
    for part in done:
        never = never.unionByName(part)
    steps = F.array(*(F.lit(x) for x in ladder))
    brackets = never.withColumns({"__low": F.get(steps, F.col("__rung") - 1), "__high": F.get(steps, F.col("__rung"))})
    closed = brackets.where(F.col("__low").isNull() | F.col("__high").isNull())
    crossing = Table(brackets.where(F.col("__low").isNotNull() & F.col("__high").isNotNull()).select(*columns, "__low", "__high"), "limits")
    tables.append(crossing)
    n = crossing.df.count()
    left = bisections
    while n and left:
        deep = min(HALVINGS, left)
        parts = 1 << deep
        width = (F.col("__high") - F.col("__low")) / parts
        seen = flags(crossing.df, F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda k: F.col("__low") + width * k), n * (parts - 1))
        # the halvings that these trials decide, from the middle outwards
        step = F.lit(0)
        for k in range(deep):
            half = parts >> (k + 1)
            step = F.when(F.get("__hit", step + half - 1), step).otherwise(step + half)
        seen = seen.withColumn("__a", step)
        low = F.col("__low") + width * F.col("__a")
        narrowed = Table(seen.select(*columns, low.alias("__low"), (low + width).alias("__high")), "limits")
        tables.append(narrowed)
        crossing, left = narrowed, left - deep
    mid = (F.col("__low") + F.col("__high")) / 2
    found = crossing.df.select(*columns, mid.alias("log_limit"), F.pow(F.lit(10.0), mid).alias("limit"), F.lit("crossed").alias("side"))
    none = F.lit(None).cast("double")
    ends = closed.select(*columns, F.coalesce("__high", "__low").alias("log_limit"), none.alias("limit"), F.when(F.col("__low").isNull(), "below").otherwise("above").alias("side"))
    result = Table(found.unionByName(ends), "limits")
    for t in tables:
        t.drop()
    return result.df


def _limits(samples: DataFrame, cells: DataFrame, model: Component, null: Component, sigma: float, kind: str, injected: bool, **search) -> DataFrame:
    """Both kinds differ in what the trial is held against: the data, or twice the null model less the data."""
    rows = Table(merged(samples), "limits-samples")
    none = observable(null.cvis(samples_uv()), kind)
    base, rest, ndof = rows.df.agg(F.sum(F.pow((none - F.col("value")) / F.col("error"), 2.0)), F.sum("rest"), F.sum("n")).first()
    if not ndof:
        raise ValueError("there are no samples")
    least = ratio_of(sigma, ndof) * (base + rest)
    held = rows.df.withColumn("value", none * 2.0 - F.col("value") if injected else F.col("value"))

    def evaluate(trials: DataFrame, n: int) -> DataFrame:
        sums = grid.evaluate(held, trials, {"chi2": grid.chi2_terms(model, kind)}, ("point_id", "__k"), n)
        return sums.select("point_id", "__k", (F.col("chi2") + rest >= least).alias("reached"))

    found = solve(cells, evaluate, **search)
    rows.drop()
    return found


def absil_limits(samples: DataFrame, cells: DataFrame, model: Component, null: Component, sigma: float, kind: str = "v2", **search) -> DataFrame:
    """Flux from which on the model fits worse than `null` by a chi-square ratio of `sigma`; see `solve`.

    `model` reads the columns of `cells` (point_id, positions) and `flux`; `null` is the model without a companion.
    """
    return _limits(samples, cells, model, null, sigma, kind, False, **search)


def injection_limits(samples: DataFrame, cells: DataFrame, model: Component, null: Component, sigma: float, kind: str = "v2", **search) -> DataFrame:
    """Flux from which on a companion added to the data makes `null` fit worse than the model by a ratio of `sigma`.

    The model's own fit to what it was added to is that of `null` to the data, and the null's fit is that of the model
    to twice the null less the data, so that no sample is copied for a flux.
    """
    return _limits(samples, cells, model, null, sigma, kind, True, **search)


def companion_sums(samples: DataFrame, cells: DataFrame, companion, primary, kind: str = "v2", injected: bool = False, n_points: int | None = None) -> DataFrame:
    """(point_id, c0 to c4, base, ndof): the chi-square of every flux of a companion, from one pass over the samples.

    With complex visibilities P of the star and C of the companion, the squared visibility at flux f is
    |P + f C|^2 / (1 + f)^2, so that (1 + f)^4 times the chi-square is a polynomial of degree four in f.
    """
    if kind != "v2":
        raise ValueError("power sums are of squared visibilities")
    p, c = primary, companion
    null = p.abs2()
    d = null * 2.0 - F.col("value") if injected else F.col("value")
    a0, a1, a2 = p.abs2() - d, ((p * c.conj()).re - d) * 2.0, c.abs2() - d
    w = 1.0 / (F.col("error") * F.col("error"))
    sums = {"c0": a0 * a0 * w, "c1": a0 * a1 * 2.0 * w, "c2": (a1 * a1 + a0 * a2 * 2.0) * w, "c3": a1 * a2 * 2.0 * w, "c4": a2 * a2 * w, "base": F.pow(null - F.col("value"), 2.0) * w, "ndof": F.lit(1)}
    return grid.evaluate(samples, cells, sums, n_points=n_points)


def limits_from_sums(sums: DataFrame, sigma: float, bounds: tuple[float, float] = (1e-6, 1.0), bisections: int = BISECTIONS) -> DataFrame:
    """(point_id, log_limit, limit, side) from `companion_sums`: the same search, as a fold in each row."""
    n = sums.agg(F.max("ndof")).first()[0]
    if not n:
        raise ValueError("there are no samples")
    least = F.col("base") * ratio_of(sigma, n)

    def reached(log: Column) -> Column:
        f = F.pow(F.lit(10.0), log)
        top = (((F.col("c4") * f + F.col("c3")) * f + F.col("c2")) * f + F.col("c1")) * f + F.col("c0")
        return top >= least * F.pow(1.0 + f, 4.0)

    ladder = _ladder(*bounds)
    steps = F.array(*(F.lit(x) for x in ladder))
    first = F.array_position(F.transform(steps, reached), F.lit(True))  # from 1, 0 where there is none
    rows = sums.withColumn("__first", first).withColumns({"__low": F.when(F.col("__first") > 1, F.get(steps, (F.col("__first") - 2).cast("int"))), "__high": F.when(F.col("__first") > 1, F.get(steps, (F.col("__first") - 1).cast("int")))})
    mid = grid.first_crossing(reached, F.col("__low"), F.col("__high"), bisections)
    log = F.when(F.col("__first") == 0, ladder[-1]).when(F.col("__first") == 1, ladder[0]).otherwise(mid)
    side = F.when(F.col("__first") == 0, "above").when(F.col("__first") == 1, "below").otherwise("crossed")
    return rows.select("point_id", log.alias("log_limit"), F.when(side == "crossed", F.pow(F.lit(10.0), log)).alias("limit"), side.alias("side"))
