"""Angles, offsets and coordinate transforms on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cx import Cx, Number, col, unit

#: Radians in a milliarcsecond.
MAS = math.pi / (180.0 * 3600.0 * 1000.0)


def floor_mod(x: Column, m: float) -> Column:
    """x modulo m with the sign of m."""
    return x - F.floor(x / m) * m


def wrap_phase(phase: Column) -> Column:
    """An angle in [-pi, pi)."""
    return floor_mod(phase + math.pi, 2 * math.pi) - math.pi


def rotate(x: Column, y: Column, degrees: Number) -> tuple[Column, Column]:
    """East and north coordinates turned by a position angle, from north through east."""
    a = F.radians(col(degrees))
    return x * F.cos(a) + y * F.sin(a), y * F.cos(a) - x * F.sin(a)


def position_angle(dra: Column, ddec: Column) -> Column:
    """Degrees from north through east, in [0, 360)."""
    return floor_mod(F.degrees(F.atan2(dra, ddec)), 360.0)


def separation_pa(dra: Column, ddec: Column) -> Column:
    return F.struct(F.hypot(dra, ddec).alias("sep"), position_angle(dra, ddec).alias("pa"))


def offset_phase(u: Column, v: Column, dra: Number, ddec: Number) -> Cx:
    """exp(-2 pi i (u dra + v ddec)) for baselines in wavelengths and offsets in mas."""
    return unit((u * col(dra) + v * col(ddec)) * (-2 * math.pi * MAS))


def deproject(u: Column, v: Column, pa: Number, stretch: Number) -> tuple[Column, Column]:
    """Baselines along the major axis and, shortened by `stretch`, along the minor axis."""
    a = F.radians(col(pa))
    major, minor = u * F.sin(a) + v * F.cos(a), u * F.cos(a) - v * F.sin(a)
    return minor * col(stretch), major


def project(x: Column, y: Column, pa: Number, stretch: Number) -> tuple[Column, Column]:
    """Sky coordinates on the minor axis, lengthened by 1 / stretch, and the major axis."""
    a = F.radians(col(pa))
    return (x * F.cos(a) - y * F.sin(a)) / col(stretch), x * F.sin(a) + y * F.cos(a)


def gaussian_taper(q2: Column, fwhm: Number) -> Column:
    """Transform of a Gaussian of this FWHM in mas at squared spatial frequency q2."""
    sigma = col(fwhm) * MAS / math.sqrt(8 * math.log(2))
    return F.exp(q2 * sigma * sigma * (-2 * math.pi**2))


def vector_angle(x: Column, y: Column) -> Column:
    return F.atan2(y, x)


def sinc(x: Column) -> Column:
    """sin(pi x) / (pi x), 1 at 0."""
    return F.when(x == 0, 1.0).otherwise(F.sin(x * math.pi) / F.when(x == 0, 1.0).otherwise(x * math.pi))
