"""Joins of observation tables: closure triangles, nearest in time, frames, folds."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import wrap_phase


def closure_triangles(baselines: DataFrame, station_triples: DataFrame) -> DataFrame:
    """(tri_id, s1, s2, s3): the samples of legs (a, b), (b, c) and (a, c), by three equi-joins on ordered pairs."""
    out = station_triples
    for leg, (p, q) in (("s1", ("a", "b")), ("s2", ("b", "c")), ("s3", ("a", "c"))):
        side = baselines.select(F.col("station_a").alias(p), F.col("station_b").alias(q), F.col("frame"), F.col("sample_id").alias(leg))
        out = out.join(side, ["frame", p, q])
    return out


def all_triangles(stations: DataFrame, by: list[str]) -> DataFrame:
    """Station triples a < b < c that close within each group `by` of a distinct (group, station) table."""
    s = lambda n: stations.select(*by, F.col("station").alias(n))
    return s("a").join(s("b"), by).where("a < b").join(s("c"), by).where("b < c")


def closure_phases(triangles: DataFrame, phases: DataFrame) -> DataFrame:
    """(tri_id, closure): phi1 + phi2 - phi3 wrapped; the legs are joined once, by exploding them with a sign."""
    legs = triangles.select("tri_id", F.explode(F.array(*(F.struct(F.col(s).alias("sample_id"), F.lit(g).alias("sign")) for s, g in (("s1", 1.0), ("s2", 1.0), ("s3", -1.0))))).alias("leg"))
    both = legs.select("tri_id", "leg.sample_id", "leg.sign").join(phases, "sample_id")
    return both.groupBy("tri_id").agg(F.sum(F.col("sign") * F.col("phi")).alias("sum"), F.count("*").alias("n")).where("n = 3").select("tri_id", wrap_phase(F.col("sum")).alias("closure"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, tolerance: float, right_id: str) -> DataFrame:
    """Each left row with the right row of its keys nearest in time within `tolerance`; first id on ties; left outer.

    Time is cut into bins of the tolerance, and the right rows, one for each time, are laid into their bin and the two
    beside it. A bin's rows of both sides are then walked in time, forwards and backwards, with the last right row seen,
    so that a crowded bin costs a sort and no pairs. `left` needs a column left_id; null keys and times match nothing.
    """
    there = lambda t: functools.reduce(operator.and_, [F.col(c).isNotNull() for c in (*keys, t)])
    once = right.where(there(right_t)).groupBy(*keys, F.col(right_t).alias("__t")).agg(F.min(right_id).alias("__id"))
    b = once.withColumn("__bin", F.explode(F.array(*(F.floor(F.col("__t") / tolerance) + d for d in (-1, 0, 1)))))
    b = b.select(*keys, "__bin", "__t", F.struct("__t", "__id").alias("__seen"), F.lit(0).alias("__side"))
    a = left.where(there(left_t)).select(*keys, F.floor(F.col(left_t) / tolerance).alias("__bin"), F.col(left_t).alias("__t"), F.lit(1).alias("__side"), "left_id")
    both = a.unionByName(b, allowMissingColumns=True)
    walk = lambda order: F.last("__seen", ignorenulls=True).over(Window.partitionBy(*keys, "__bin").orderBy(order, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = both.withColumn("__before", walk(F.asc("__t"))).withColumn("__after", walk(F.desc("__t"))).where("__side = 1")
    near = lambda c: F.when(F.abs(F.col(f"{c}.__t") - F.col("__t")) <= tolerance, F.struct(F.abs(F.col(f"{c}.__t") - F.col("__t")).alias("d"), F.col(f"{c}.__id").alias("id")))
    found = seen.select("left_id", F.least(near("__before"), near("__after")).alias("m")).where("m is not null")
    best = found.groupBy("left_id").agg(F.min("m").alias("m")).select("left_id", F.col("m.id").alias(right_id), F.col("m.d").alias("distance"))
    return left.join(best, "left_id", "left")


def range_pairs(df: DataFrame, keys: list[str], t: str, tolerance: float, id: str) -> DataFrame:
    """Pairs (i, j), i < j, of rows of one key within `tolerance` in time, by bins of that width."""
    a = df.select(*keys, F.col(id).alias("i"), F.col(t).alias("ti"), F.explode(F.array(*((F.floor(F.col(t) / tolerance) + d) for d in (-1, 0, 1)))).alias("bin"))
    b = df.select(*keys, F.col(id).alias("j"), F.col(t).alias("tj"), F.floor(F.col(t) / tolerance).alias("bin"))
    return a.join(b, [*keys, "bin"]).where((F.col("i") < F.col("j")) & (F.abs(F.col("ti") - F.col("tj")) <= tolerance)).select(*keys, "i", "j")


def frames(df: DataFrame, keys: list[str], t: str, tolerance: float = 1e-4) -> DataFrame:
    """Add frame: rows of one key that chains of `tolerance` join in time, numbered from 0."""
    order = Window.partitionBy(*keys).orderBy(t)
    new = (F.col(t) - F.lag(t).over(order)) > tolerance
    return df.withColumn("__new", F.coalesce(new.cast("int"), F.lit(0))).withColumn("frame", F.sum("__new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")


def epochs(df: DataFrame, keys: list[str], t: str, frame: str | None = None, gap_days: float = 0.5) -> DataFrame:
    """Add epoch (from 0): runs of frames whose mean times lie `gap_days` or less apart; frames are never split."""
    if frame is None:
        order = Window.partitionBy(*keys).orderBy(t)
        new = F.coalesce(((F.col(t) - F.lag(t).over(order)) > gap_days).cast("int"), F.lit(0))
        return df.withColumn("__new", new).withColumn("epoch", F.sum("__new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("__new")
    means = df.groupBy(*keys, frame).agg(F.avg(t).alias("__t"))
    return df.join(epochs(means, keys, "__t", None, gap_days).drop("__t"), [*keys, frame])


def dartboard_cells(u: Column, v: Column, q_min: float, q_max: float, n_q: int = 12, n_phi: int = 16) -> tuple[Column, Column]:
    """(annulus, sector) of a baseline folded to v >= 0: annuli even in log radius, sectors even in angle."""
    flip = F.when((v < 0) | ((v == 0) & (u < 0)), -1.0).otherwise(1.0)
    q = F.hypot(u, v)
    ring = F.when(q <= q_min, 0).otherwise(F.floor(F.log(F.greatest(q, F.lit(q_min)) / q_min) / math.log(q_max / q_min) * n_q)).cast("int")
    clip = lambda x, n: F.least(F.greatest(x, F.lit(0)), F.lit(n - 1))
    return clip(ring, n_q), clip(F.floor(F.atan2(v * flip, u * flip) / math.pi * n_phi).cast("int"), n_phi)


def dartboard_folds(df: DataFrame, k: int = 5, n_q: int = 12, n_phi: int = 16, seed: str = "0") -> DataFrame:
    """Add fold: the occupied cells, at most n_q x n_phi, shuffled by a hash and dealt to k folds in turn."""
    low, high = df.where(F.hypot("u", "v") > 0).agg(F.min(F.hypot("u", "v")), F.max(F.hypot("u", "v"))).first()
    ring, sector = dartboard_cells(F.col("u"), F.col("v"), low, high * (1 + 1e-12), n_q, n_phi)
    out = df.withColumn("__cell", ring * n_phi + sector)
    order = Window.orderBy(F.md5(F.concat_ws("/", F.lit(seed), F.col("__cell").cast("string")).cast("binary")))
    cells = out.select("__cell").distinct().withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("int"))
    return out.join(F.broadcast(cells), "__cell").drop("__cell")
