"""Populations of particles as tables: systematic resampling by prefix sums, tempered and bridging sequential Monte Carlo.

No population reaches the driver: it sees sums, a temperature and a covariance. A step reads the particles, writes them
anew and drops the table before.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.detection import normal, uniform
from .work import Table

#: Weights are whole numbers up to this, so that sums are exact whatever their order.
UNITS = 1 << 40
#: Particles of a slice of the order, which one task sums up.
SLICE = 50_000
#: Steps of temperature that one pass over the particles tries.
TRIALS = 32


def resample(particles: DataFrame, log_weight: str, n: int, id: str = "particle", seed: int = 0, offset: float | None = None, slice_of: Column | None = None) -> DataFrame:
    """`particles` with `draws`, how often each is drawn in `n` systematic draws, and `first`, the number of its first draw.

    Draws are within one of n times the weight's share, add up to n, and are the same in every run. Weights are taken
    to 2^-40 of the largest; null and NaN ones count as nothing. The order is by slices (a hash of the id, or
    `slice_of`) and within these by id, which should be unique: sums of slices are added up over a table with a row for
    each slice, and running sums are made within slices.
    """
    top, rows = particles.where(F.col(log_weight).isNotNull() & ~F.isnan(log_weight)).agg(F.max(log_weight), F.count("*")).first()
    slices = max(1, -(-(rows or 0) // SLICE))
    if top is None or top == -math.inf:
        raise ValueError("no particle has any weight")
    units = F.floor(F.exp(F.col(log_weight) - top) * float(UNITS) + 0.5)
    units = F.when(F.col(log_weight).isNull() | F.isnan(log_weight), 0).otherwise(units).cast("decimal(38,0)")
    held = particles.withColumns({"__units": units, "__slice": F.pmod(F.xxhash64(id), F.lit(slices)) if slice_of is None else slice_of})
    sums = held.groupBy("__slice").agg(F.sum("__units").cast("decimal(38,0)").alias("__sum"))
    total = int(sums.agg(F.sum("__sum")).first()[0])
    start = int((random.Random(seed).random() if offset is None else offset) * total)
    before = sums.select("__slice", F.coalesce(F.sum("__sum").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,0)").alias("__before"))
    upto = F.sum("__units").over(Window.partitionBy("__slice").orderBy(id).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = held.withColumn("__own", upto).join(F.broadcast(before), "__slice")
    # draw k lies at k * total + start, a particle holds the places from n times the sum before it to n times the sum with it
    place = lambda c: (c * n - start).cast("decimal(38,0)")
    count = lambda x: F.when(x <= 0, 0).otherwise(F.call_function("div", x + (total - 1), F.lit(total).cast("decimal(38,0)")))
    high = count(place(F.col("__before") + F.col("__own")))
    low = count(place(F.col("__before") + F.col("__own") - F.col("__units")))
    return placed.select(*particles.columns, (high - low).cast("long").alias("draws"), low.cast("long").alias("first"))


def drawn(resampled: DataFrame, id: str = "particle") -> DataFrame:
    """One row for each draw, numbered from 0 in place of the particles' ids."""
    copies = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("draws") - 1))
    rest = [c for c in resampled.columns if c not in (id, "draws", "first")]
    return resampled.where("draws > 0").select(copies.alias(id), *rest)


@dataclass
class Population:
    """Particles (particle, parameters, start, end) at the last temperature, the log evidence, and a record of each step."""

    table: Table
    log_evidence: float
    steps: list[dict] = field(default_factory=list)

    @property
    def df(self) -> DataFrame:
        return self.table.df


def _next_step(particles: DataFrame, beta: float, ess: float) -> tuple[float, float]:
    """The largest step in temperature that keeps the effective share of particles at `ess`, and the log mean weight there."""
    gain = F.col("end") - F.col("start")
    top = particles.agg(F.max(gain)).first()[0]

    def at(steps: list[float]) -> list[tuple[float, float]]:
        w = lambda d: F.exp((gain - top) * d)
        sums = [x for i, d in enumerate(steps) for x in (F.sum(w(d)).alias(f"a{i}"), F.sum(w(2 * d)).alias(f"b{i}"))]
        r = particles.agg(F.count("*").alias("n"), *sums).first()
        return [(r[f"a{i}"] ** 2 / r[f"b{i}"] / r["n"], math.log(r[f"a{i}"] / r["n"]) + top * d) for i, d in enumerate(steps)]

    low, high = 0.0, 1.0 - beta
    (whole, log_mean) = at([high])[0]
    if whole >= ess:
        return high, log_mean
    for _ in range(2):
        steps = [low + (high - low) * (k + 1) / (TRIALS + 1) for k in range(TRIALS)] if low else np.geomspace(high * 1e-6, high, TRIALS + 1)[:-1].tolist()
        good = [s for s, (share, _) in zip(steps, at(steps)) if share >= ess]
        low, high = (max(good), min([s for s in steps if s > max(good)] + [high])) if good else (low, steps[0])
    low = low or high
    return low, at([low])[0][1]


def _proposal(particles: DataFrame, names: list[str], scale: float) -> np.ndarray:
    """A square root of the population's covariance, scaled for a random walk."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    r = particles.agg(*[F.covar_pop(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    cov = np.zeros((len(names),) * 2)
    for (a, b), v in zip(pairs, r):
        i, j = names.index(a), names.index(b)
        cov[i, j] = cov[j, i] = v
    values, vectors = np.linalg.eigh(cov)
    return vectors * np.sqrt(np.maximum(values, 0)) * scale / math.sqrt(len(names))


def bridge(prior: DataFrame, names: list[str], log_prior: Column, evaluate: Callable[[DataFrame], DataFrame], ess: float = 0.5, moves: int = 4, seed: int = 0, scale: float = 2.38, most: int = 100) -> Population:
    """Sequential Monte Carlo from `prior` (particle, names) drawn from exp(log_prior + start) to exp(log_prior + end).

    `evaluate(points)` gives (particle, start, end) of points: log likelihoods of the two ends, start 0 for tempering
    from the prior. Every step raises the temperature as far as the effective share of particles stays `ess`, resamples,
    and moves each particle `moves` times by a random walk with the population's covariance. Numbers are drawn by hashes
    of (seed, step, move, particle), so that a task that is run again draws the same. The log evidence is of `end`
    against `start`.
    """
    def scored(points: DataFrame) -> DataFrame:
        return points.join(evaluate(points.select("particle", *names)), "particle")

    now = Table(scored(prior.select("particle", *names)), "particles")
    n = now.df.count()
    beta, out, steps = 0.0, 0.0, []
    while beta < 1 and len(steps) < most:
        step, log_mean = _next_step(now.df, beta, ess)
        beta, out = min(1.0, beta + step), out + log_mean
        weighted = now.df.withColumn("__w", (F.col("end") - F.col("start")) * step)
        after = Table(drawn(resample(weighted, "__w", n, seed=seed * 1000 + len(steps))).drop("__w"), "particles")
        now.drop()
        now = after
        root, taken = _proposal(now.df, names, scale), 0
        for move in range(moves):
            z = [normal(F.lit(seed), F.lit(len(steps)), F.lit(move), F.lit(k), "particle") for k in range(len(names))]
            shifted = {p: F.col(p) + sum((z[k] * float(root[i, k]) for k in range(len(names))), F.lit(0.0)) for i, p in enumerate(names)}
            tried = now.df.select("particle", *[x.alias(p) for p, x in shifted.items()])
            lp = log_prior
            inside = tried.where(lp > -math.inf)
            new = scored(inside).withColumn("__lp", lp).select(F.col("particle").alias("__id"), F.struct(*names, "start", "end", "__lp").alias("new"))
            both = now.df.withColumn("__lp", lp).join(new, F.col("particle") == F.col("__id"), "left")
            target = lambda s, e, p: s * (1 - beta) + e * beta + p
            rise = target(F.col("new.start"), F.col("new.end"), F.col("new.__lp")) - target(F.col("start"), F.col("end"), F.col("__lp"))
            yes = F.coalesce(F.log(1.0 - uniform(F.lit(3), F.lit(seed), F.lit(len(steps)), F.lit(move), "particle")) < rise, F.lit(False))
            moved = [F.when(F.col("__yes"), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in (*names, "start", "end")]
            after = Table(both.withColumn("__yes", yes).select("particle", *moved, F.col("__yes").alias("moved")), "particles")
            taken += after.df.where("moved").count()
            now.drop()
            now = after
        steps.append({"beta": beta, "log_evidence": out, "accepted": taken / max(1, n * moves)})
    return Population(now, out, steps)
