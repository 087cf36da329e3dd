"""Spectra as functions of the wavelength column; a component's flux may be one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cx import Number, col

Spectrum = Callable[[Column], Column]


def flux_at(flux: Number | str | Spectrum, wavel: Column) -> Column:
    """A number, a column or a spectrum at a wavelength."""
    return flux(wavel) if callable(flux) and not isinstance(flux, Column) else col(flux)


def nodes(values: list[float], wavel: list[float], outside: str = "constant") -> Spectrum:
    """Linear interpolation through values at rising wavelengths; beyond them constant, or zero.

    The segment is found by comparisons in generated code, as a spectrum has few nodes.
    """
    if len(values) != len(wavel) or not values or sorted(set(wavel)) != list(wavel):
        raise ValueError("nodes need as many values as strictly rising wavelengths")

    def at(w: Column) -> Column:
        first, last = (values[0], values[-1]) if outside == "constant" else (0.0, 0.0)
        out = F.when(w < wavel[0], first)
        for a, b, x, y in zip(wavel, wavel[1:], values, values[1:]):
            out = out.when(w <= b, (w - a) * ((y - x) / (b - a)) + x)
        return out.when(w == wavel[-1], values[-1]).otherwise(last)

    return at


def scaled(template: Spectrum, ratio: Number | str, wavel0: float) -> Spectrum:
    """A tabulated shape times a free flux: `ratio` at wavel0."""
    return lambda w: template(w) / template(F.lit(wavel0)) * col(ratio)


def total(*parts: Number | str | Spectrum) -> Spectrum:
    """The sum of spectra and numbers."""

    def at(w: Column) -> Column:
        out = F.lit(0.0)
        for p in parts:
            out = out + flux_at(p, w)
        return out

    return at
