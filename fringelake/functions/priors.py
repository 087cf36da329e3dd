"""Densities of directions in space and of positive scales, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cx import Number, col


def inclination_log_density(degrees: Column, low: float = 0.0, high: float = 180.0) -> Column:
    """log density, a degree, of an inclination that is isotropic between two bounds: proportional to its sine."""
    norm = math.cos(math.radians(low)) - math.cos(math.radians(high))
    inside = degrees.between(low, high)
    return F.when(inside, F.log(F.sin(F.radians(degrees)) * (math.pi / 180 / norm))).otherwise(float("-inf"))


def inclination_cdf(degrees: Column, low: float = 0.0, high: float = 180.0) -> Column:
    top, bottom = math.cos(math.radians(low)), math.cos(math.radians(high))
    at = F.least(F.greatest(degrees, F.lit(low)), F.lit(high))
    return (F.lit(top) - F.cos(F.radians(at))) / (top - bottom)


def inclination_quantile(p: Column, low: float = 0.0, high: float = 180.0) -> Column:
    top, bottom = math.cos(math.radians(low)), math.cos(math.radians(high))
    return F.degrees(F.acos(F.lit(top) - p * (top - bottom)))


def latitude_log_density(radians: Column, low: float = -math.pi / 2, high: float = math.pi / 2) -> Column:
    """log density of a latitude that is isotropic between two bounds: proportional to its cosine."""
    return F.when(radians.between(low, high), F.log(F.cos(radians) / (math.sin(high) - math.sin(low)))).otherwise(float("-inf"))


def latitude_quantile(p: Column, low: float = -math.pi / 2, high: float = math.pi / 2) -> Column:
    return F.asin(p * (math.sin(high) - math.sin(low)) + math.sin(low))


def hierarchical_scale(z: Column, median: Number, spread: Number) -> Column:
    """A positive scale of a log-normal population, from a standard normal deviate."""
    return col(median) * F.exp(z * col(spread))
