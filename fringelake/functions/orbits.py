"""Orbits on columns: Kepler's equation, Thiele-Innes constants, velocities, masses."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cx import Number, col
from .geometry import floor_mod

# IAU 2015 nominal solar mass parameter, the astronomical unit and the day.
GM_SUN, AU, DAY = 1.3271244e20, 149597870700.0, 86400.0


def eccentric_anomaly(mean: Column, ecc: Column, steps: int = 8) -> Column:
    """E with E - e sin E = M: a start that no eccentricity upsets, then a fixed number of Newton steps in one fold."""
    m = floor_mod(mean + math.pi, 2 * math.pi) - math.pi
    start = m + ecc * F.sin(m) / (1.0 - F.sin(m + ecc) + F.sin(m))
    start = F.when(ecc < 0.8, start).otherwise(F.when(m < 0, -math.pi).otherwise(math.pi) * 1.0)
    fold = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.struct(start.cast("double").alias("x"), m.cast("double").alias("m"), ecc.cast("double").alias("e")),
        lambda s, _: F.struct((s["x"] - (s["x"] - s["e"] * F.sin(s["x"]) - s["m"]) / (1.0 - s["e"] * F.cos(s["x"]))).alias("x"), s["m"].alias("m"), s["e"].alias("e")),
    )
    return fold["x"]


@dataclass(frozen=True)
class Kepler:
    """Elements, each a number, a column or a column's name; angles in degrees, a in mas, times in days."""

    period: Number | str
    t_peri: Number | str
    ecc: Number | str = 0.0
    inc: Number | str = 0.0
    omega: Number | str = 0.0
    Omega: Number | str = 0.0
    a: Number | str = 1.0

    def thiele_innes(self) -> dict[str, Column]:
        """A, B, F, G in mas on north and east; C, H on the line of sight."""
        w, o, i, a = F.radians(col(self.omega)), F.radians(col(self.Omega)), F.radians(col(self.inc)), col(self.a)
        cw, sw, co, so, ci, si = F.cos(w), F.sin(w), F.cos(o), F.sin(o), F.cos(i), F.sin(i)
        return {
            "A": a * (cw * co - sw * so * ci), "B": a * (cw * so + sw * co * ci), "F": -a * (sw * co + cw * so * ci),
            "G": -a * (sw * so - cw * co * ci), "C": a * sw * si, "H": a * cw * si,
        }

    def plane(self, mjd: Column, steps: int = 8) -> tuple[Column, Column, Column]:
        """(X, Y, E): the position in the orbit's plane in units of a, and the eccentric anomaly."""
        e = col(self.ecc)
        big = eccentric_anomaly((mjd - col(self.t_peri)) * (2 * math.pi) / col(self.period), e, steps)
        return F.cos(big) - e, F.sqrt(1.0 - e * e) * F.sin(big), big

    def relative(self, mjd: Column, steps: int = 8) -> tuple[Column, Column]:
        """(dra, ddec) in mas at a time."""
        x, y, _ = self.plane(mjd, steps)
        t = self.thiele_innes()
        return t["B"] * x + t["G"] * y, t["A"] * x + t["F"] * y

    def radial(self, mjd: Column) -> Column:
        """Velocity along the line of sight, away, in mas a day."""
        x, y, big = self.plane(mjd)
        e = col(self.ecc)
        rate = F.lit(2 * math.pi) / (col(self.period) * (1.0 - e * F.cos(big)))
        t = self.thiele_innes()
        return -(t["C"] * F.sin(big) - t["H"] * F.sqrt(1.0 - e * e) * F.cos(big)) * rate


def to_kepler(A: Column, B: Column, Fc: Column, G: Column) -> dict[str, Column]:
    """a, inc, omega, Omega of Thiele-Innes constants; Omega in [0, 180)."""
    plus, minus = F.atan2(B - Fc, A + G), F.atan2(-B - Fc, A - G)
    u, w = (A * A + B * B + Fc * Fc + G * G) / 2, A * G - B * Fc
    a = F.sqrt(u + F.sqrt(F.greatest(u * u - w * w, F.lit(0.0))))
    node = (plus - minus) / 2
    turn = F.floor(node / math.pi) * math.pi
    return {"a": a, "inc": F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w / (a * a))))), "omega": floor_mod(F.degrees((plus + minus) / 2 - turn), 360.0), "Omega": F.degrees(node - turn)}


def total_mass(a: Column, period: Column, distance_pc: Number) -> Column:
    """Solar masses by Kepler's third law, a in mas and the period in days."""
    size, seconds = a * col(distance_pc) / 1000.0 * AU, period * DAY
    return size * size * size * (4 * math.pi**2 / GM_SUN) / (seconds * seconds)


def distance_pc(a: Column, period: Column, mass: Number) -> Column:
    """Parsecs at which the orbit has this total mass."""
    seconds = period * DAY
    return F.pow(col(mass) * GM_SUN * seconds * seconds / (4 * math.pi**2), 1.0 / 3.0) / AU / a * 1000.0


def radial_velocity(orbit: Kepler, mjd: Column, q: Number, gamma: Number, distance: Number, star: Column) -> Column:
    """Velocity of the primary or the secondary in km/s; q is secondary mass over primary mass."""
    kms = orbit.radial(mjd) * col(distance) / 1000.0 * (AU / DAY / 1000.0)
    return col(gamma) + kms * F.when(star == "primary", -col(q) / (1.0 + col(q))).otherwise(1.0 / (1.0 + col(q)))
