"""Grids of models against samples: points x samples, summed by point in one shuffle."""

from __future__ import annotations

import itertools
import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from ..functions.photometry import observable
from .models import Component, Uv, samples_uv

#: Rows of a points table that are broadcast at once: 2^17 rows of a few doubles are some 10 MB.
BLOCK = 1 << 17
#: Rows from which the bounds of an order's slices are taken.
SAMPLE = 20_000


def axes(spark: SparkSession, **values: list[float]) -> DataFrame:
    """points(point_id, one column per axis): every combination, the last axis fastest, built on the executors.

    An id is a mixed-radix number over the axes, so a grid of any size needs no join and no list of its points.
    """
    names, sizes = list(values), [len(v) for v in values.values()]
    out, stride = spark.range(math.prod(sizes)).withColumnRenamed("id", "point_id"), 1
    columns = {}
    for name, n in zip(reversed(names), reversed(sizes)):
        at = F.floor(F.col("point_id") / stride) % n
        columns[name] = F.element_at(F.array(*map(F.lit, map(float, values[name]))), (at + 1).cast("int"))
        stride *= n
    return out.select("point_id", *(columns[n].alias(n) for n in names))


def evaluate(samples: DataFrame, points: DataFrame, sums: dict[str, Column], keys: tuple[str, ...] = ("point_id",), n_points: int | None = None) -> DataFrame:
    """`sums` over the samples for every point: the samples stay where they lie and the points travel.

    The points are broadcast while they are at most BLOCK, and otherwise in blocks of that size, one pass over the
    samples each; partial sums are combined before the one shuffle on the key.
    """
    n = points.count() if n_points is None else n_points
    aggs = [F.sum(x).alias(name) for name, x in sums.items()]
    if n <= BLOCK:
        return samples.crossJoin(F.broadcast(points)).groupBy(*keys).agg(*aggs)
    blocks = math.ceil(n / BLOCK)
    dealt = points.withColumn("__block", F.pmod(F.xxhash64(*keys), F.lit(blocks)))
    parts = [samples.crossJoin(F.broadcast(dealt.where(F.col("__block") == b).drop("__block"))).groupBy(*keys).agg(*aggs) for b in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chi2_terms(model: Component, kind: str = "v2", value: str = "value", error: str = "error", uv: Uv | None = None) -> Column:
    """One sample's squared whitened residual."""
    r = (observable(model.cvis(uv or samples_uv()), kind) - F.col(value)) / F.col(error)
    return r * r


def likelihood_grid(samples: DataFrame, points: DataFrame, model: Component, kind: str = "v2", normalised: bool = False, n_points: int | None = None) -> DataFrame:
    """(point_id, loglike) of every point; with `normalised` the full Gaussian density."""
    sums = {"chi2": chi2_terms(model, kind)}
    if normalised:
        sums["norm"] = F.log(F.col("error")) + 0.5 * math.log(2 * math.pi)
    out = evaluate(samples, points, sums, n_points=n_points)
    return out.select("point_id", (F.col("chi2") * -0.5 - (F.col("norm") if normalised else 0.0)).alias("loglike"))


def best_point(grid: DataFrame, score: str = "loglike", id: str = "point_id") -> DataFrame:
    """The point of the largest finite score; of equal ones the first."""
    return grid.where(~F.isnan(score)).orderBy(F.desc(score), id).limit(1)


def best_per(grid: DataFrame, by: list[str], score: str = "loglike", id: str = "point_id") -> DataFrame:
    """The best point of each group, by a grouped maximum that combines before its shuffle."""
    rest = [c for c in grid.columns if c not in by]
    top = grid.where(~F.isnan(score)).groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(id))).alias("top"))
    return top.select(*by, "top.*")


def linear_flux(samples: DataFrame, points: DataFrame, derivative: Column, residual: Column, error: str = "error", prior: tuple[float, float] | None = None) -> DataFrame:
    """(point_id, flux, flux_error, snr) of a flux that enters linearly: sums of x d / s^2 and x^2 / s^2.

    With a Gaussian prior (mean, sd) also its posterior mean and sd and the log Bayes factor against no flux.
    """
    s2 = F.col(error) * F.col(error)
    out = evaluate(samples, points, {"b": derivative * residual / s2, "c": derivative * derivative / s2})
    c = F.when(F.col("c") > 0, F.col("c"))
    cols = [(F.col("b") / c).alias("flux"), (1.0 / F.sqrt(c)).alias("flux_error"), (F.col("b") / F.sqrt(c)).alias("snr")]
    if prior:
        m, sd = prior
        p, h = F.col("c") + 1 / sd**2, F.col("b") + m / sd**2
        cols += [(h / p).alias("post_mean"), (1.0 / F.sqrt(p)).alias("post_sd"), (F.log(p * sd**2) * -0.5 + h * h / (p * 2) - m * m / (2 * sd * sd)).alias("log_bayes")]
    return out.select("point_id", *cols)


def log_bayes_factor(grid: DataFrame, axes: dict[str, list[float]], null: float | Column, score: str = "loglike") -> DataFrame:
    """One row: log of the mean likelihood over the grid against `null`, by trapezoid weights of each axis.

    Ends of an axis weigh half; each axis' weights sum to one; NaN counts as no likelihood.
    """
    w = F.lit(1.0)
    for name, values in axes.items():
        n = len(values)
        if n > 1:
            w = w * F.when(F.col(name).isin(float(values[0]), float(values[-1])), 0.5 / (n - 1)).otherwise(1.0 / (n - 1))
    rel = grid.where(~F.isnan(score)).select((F.col(score) - null).alias("x"), w.alias("w"))
    top = rel.agg(F.max("x").alias("m"))
    return rel.crossJoin(F.broadcast(top)).agg((F.first("m") + F.log(F.sum(F.col("w") * F.exp(F.col("x") - F.col("m"))))).alias("log_bayes_factor"))


def first_crossing(reached, low: Column, high: Column, bisections: int = 22) -> Column:
    """The boundary of a monotone predicate in [low, high] by a fixed number of bisections, in one fold of columns."""
    start = F.struct(low.cast("double").alias("a"), high.cast("double").alias("b"))

    def step(s, _):
        m = (s["a"] + s["b"]) / 2
        hit = reached(m)
        return F.struct(F.when(hit, s["a"]).otherwise(m).alias("a"), F.when(hit, m).otherwise(s["b"]).alias("b"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(bisections)), start, step)
    return (out["a"] + out["b"]) / 2


def peaks(grid: DataFrame, x: list[float], y: list[float], rival: float, n_peaks: int, score: str = "score") -> list[tuple[float, float, float]]:
    """Local maxima of a map (ix, iy, score), highest first, each further than `rival` from every higher one taken.

    Neighbours are met by an equi-join on shifted indices; the few local maxima are thinned on the driver.
    """
    shifts = [(a, b) for a, b in itertools.product((-1, 0, 1), repeat=2) if (a, b) != (0, 0)]
    around = grid.select(F.explode(F.array(*(F.struct((F.col("ix") + a).alias("ix"), (F.col("iy") + b).alias("iy"), F.col(score).alias("s")) for a, b in shifts))).alias("n")).select("n.*")
    most = around.groupBy("ix", "iy").agg(F.max("s").alias("most"))
    tops = grid.join(most, ["ix", "iy"], "left").where(F.col("most").isNull() | (F.col(score) >= F.col("most")))
    out: list[tuple[float, float, float]] = []
    for r in tops.orderBy(F.desc(score), "ix", "iy").limit(64 * n_peaks).collect():
        p = (x[r.ix], y[r.iy], r[score])
        if all(math.hypot(p[0] - q[0], p[1] - q[1]) > rival for q in out):
            out.append(p)
        if len(out) == n_peaks:
            break
    return out


def _slice_of(bounds: np.ndarray):
    """How many of the sorted bounds are at most a row's (level, index); complex numbers sort by both parts in turn."""

    def find(level: pd.Series, index: pd.Series) -> pd.Series:
        key = np.empty(len(level), complex)
        key.real, key.imag = level, index
        return pd.Series(np.searchsorted(bounds, key, "right").astype("int32"))

    return F.pandas_udf(find, "int")


def rank_scores(df: DataFrame, score: str, index: str, quantum: float = 1e-3) -> DataFrame:
    """Add rank (long, from 1): scores that are not finite last, then floor(score / quantum + 1/2) downwards, then index.

    Rows are dealt into slices of the order, as many as there are shuffle partitions, at bounds taken from a bounded
    sample; each slice is numbered by itself and shifted by the counted rows of those before it. Where the bounds lie
    moves work, not ranks. `index` should be unique: a number, or a struct that begins with one, also parts rows of
    equal scores; any other orderable column leaves these in one slice.
    """
    s = F.col(score)
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    level = F.when(finite, (-F.floor(s / quantum + 0.5)).cast("double")).otherwise(sys.float_info.max)
    kind, first = df.schema[index].dataType, F.col(index)
    if isinstance(kind, StructType):
        kind, first = kind[0].dataType, F.col(f"{index}.{kind.names[0]}")
    # nulls come first, as in the order; what is not a number is left to the order within a slice
    number = F.coalesce(F.nanvl(first.cast("double"), F.lit(sys.float_info.max)), F.lit(-sys.float_info.max)) if isinstance(kind, NumericType) else F.lit(0.0)
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.count()
    some = df.select(level.alias("a"), number.alias("b")).sample(min(1.0, SAMPLE / max(rows, 1)), seed=1).limit(2 * SAMPLE).toArrow()
    keys = np.empty(len(some), complex)
    keys.real, keys.imag = some["a"].to_numpy(), some["b"].to_numpy()
    bounds = np.unique(np.sort(keys)[np.arange(1, slices) * len(keys) // slices]) if len(keys) else keys
    slice_of = _slice_of(bounds)
    dealt = df.withColumn("__level", level).withColumn("__slice", slice_of("__level", number))
    before = df.select(slice_of(level, number).alias("__slice")).groupBy("__slice").agg(F.count("*").alias("n"))
    before = before.select("__slice", F.sum("n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__slice").orderBy("__level", index))
    out = dealt.withColumn("__place", place).join(F.broadcast(before), "__slice")
    return out.withColumn("rank", F.col("__place") + F.coalesce("__before", F.lit(0))).drop("__slice", "__level", "__place", "__before")
