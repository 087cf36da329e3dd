"""Selections and error models of observation tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import rotate
from ..functions.photometry import flagged


def in_ranges(x: Column, ranges: list[tuple[float, float]]) -> Column:
    """Whether x lies in any closed range."""
    return reduce(lambda a, b: a | b, (x.between(lo, hi) for lo, hi in ranges), F.lit(False))


def select(samples: DataFrame, wavel_min: float | None = None, wavel_max: float | None = None, ranges=None, exclude=None) -> DataFrame:
    """Rows in a wavelength window, in any of `ranges` and in none of `exclude`; the filters reach the scan."""
    keep = F.lit(True)
    if wavel_min is not None:
        keep = keep & (F.col("wavel") >= wavel_min)
    if wavel_max is not None:
        keep = keep & (F.col("wavel") <= wavel_max)
    if ranges:
        keep = keep & in_ranges(F.col("wavel"), ranges)
    if exclude:
        keep = keep & ~in_ranges(F.col("wavel"), exclude)
    return samples.where(keep)


def split_triangles(triangles: DataFrame, part: DataFrame) -> DataFrame:
    """Triangles whose three samples do not all lie in one part of `part` (sample_id, part); a partition needs none."""
    legs = triangles.select("tri_id", F.explode(F.array("s1", "s2", "s3")).alias("sample_id"))
    return legs.join(part, "sample_id", "left").groupBy("tri_id").agg(F.count_distinct(F.coalesce(F.col("part").cast("string"), F.lit("none"))).alias("parts")).where("parts > 1")


def unflagged(samples: DataFrame, vis: DataFrame, triangles: DataFrame) -> DataFrame:
    """Samples that a good visibility or a leg of a good triangle uses."""
    good = vis.where(~flagged(F.col("value"), F.col("error"), F.col("flag"))).select("sample_id")
    legs = triangles.where(~flagged(F.col("phi"), F.col("d_phi"), F.col("flag"))).select(F.explode(F.array("s1", "s2", "s3")).alias("sample_id"))
    return samples.join(good.union(legs), "sample_id", "left_semi")


def with_error_floor(df: DataFrame, absolute: float | None = None, relative: float | None = None, value: str = "value", error: str = "error") -> DataFrame:
    terms = [F.col(error)] + ([F.lit(float(absolute))] if absolute is not None else []) + ([F.abs(F.col(value)) * relative] if relative is not None else [])
    return df.withColumn(error, F.greatest(*terms) if len(terms) > 1 else terms[0])


def with_wavelength_scale(samples: DataFrame, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    return samples.withColumn("wavel", F.col("wavel") * scale + offset)


def with_north_angle(samples: DataFrame, degrees: float) -> DataFrame:
    u, v = rotate(F.col("u"), F.col("v"), degrees)
    return samples.withColumns({"u": u, "v": v})


def union_runs(*runs: DataFrame) -> DataFrame:
    """All rows of several files under one composite key (run, local id), whatever ids each file used."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (r.withColumn("run", F.lit(i)) for i, r in enumerate(runs)))


def common_channels(df: DataFrame, row: str = "row_id", channel: str = "channel") -> DataFrame:
    """Channels that every row of a block has."""
    rows = df.agg(F.count_distinct(row).alias("rows"))
    return df.groupBy(channel).agg(F.count_distinct(row).alias("n")).crossJoin(F.broadcast(rows)).where("n = rows").select(channel)


def fold_masks(df: DataFrame, k: int, fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, test) of fold k."""
    return df.where(F.col(fold) != k), df.where(F.col(fold) == k)


def fringe_scales(samples: DataFrame) -> DataFrame:
    """Smallest and largest fringe spacing in mas, and the smallest smearing scale, over the given samples."""
    mas = 180 * 3600e3 / math.pi
    b = F.hypot("u", "v")
    return samples.agg((mas / F.max(b / F.col("wavel"))).alias("finest"), (mas / F.min(F.when(b > 0, b / F.col("wavel")))).alias("coarsest"))
