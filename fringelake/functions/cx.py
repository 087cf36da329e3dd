"""Complex numbers as pairs of double columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def col(x: Number | str) -> Column:
    """A column from a number, a column or the name of one."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


@dataclass(frozen=True)
class Cx:
    re: Column
    im: Column

    def __add__(self, other: Cx) -> Cx:
        return Cx(self.re + other.re, self.im + other.im)

    def __sub__(self, other: Cx) -> Cx:
        return Cx(self.re - other.re, self.im - other.im)

    def __mul__(self, other: Cx | Number) -> Cx:
        if isinstance(other, Cx):
            return Cx(self.re * other.re - self.im * other.im, self.re * other.im + self.im * other.re)
        return Cx(self.re * other, self.im * other)

    def __truediv__(self, other: Number) -> Cx:
        return Cx(self.re / other, self.im / other)

    def conj(self) -> Cx:
        return Cx(self.re, -self.im)

    def abs2(self) -> Column:
        return self.re * self.re + self.im * self.im

    def abs(self) -> Column:
        return F.sqrt(self.abs2())

    def arg(self) -> Column:
        return F.atan2(self.im, self.re)


def real(x: Number) -> Cx:
    return Cx(col(x), F.lit(0.0))


def unit(phase: Column) -> Cx:
    """exp(i phase)."""
    return Cx(F.cos(phase), F.sin(phase))
