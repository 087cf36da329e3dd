"""Flux ratios, contrasts, magnitudes, spectra and error models on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cx import Number, col

#: Planck constant times light speed over Boltzmann constant, in metre kelvin.
HC_K = 0.014387768775039337


def flux_to_contrast(flux: Column) -> Column:
    return 1.0 / F.greatest(flux, F.lit(1e-30))


def contrast_to_flux(contrast: Column) -> Column:
    """1 / contrast, infinite at 0."""
    return F.when(contrast == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), contrast))


def flux_to_delta_mag(flux: Column) -> Column:
    return F.log10(flux_to_contrast(flux)) * 2.5


def delta_mag_to_flux(mag: Column) -> Column:
    return F.pow(F.lit(10.0), mag * -0.4)


def power_law(ratio: Number, index: Number, wavel: Column, wavel0: float = 1.65e-6) -> Column:
    return col(ratio) * F.pow(wavel / wavel0, col(index))


def black_body(ratio: Number, temperature: Number, wavel: Column, wavel0: float = 1.65e-6) -> Column:
    """A Planck spectrum in wavelength, scaled to `ratio` at wavel0."""
    t = col(temperature)
    shape = lambda w: F.pow(w, -5.0) / F.expm1(HC_K / (w * t))
    return col(ratio) * shape(wavel) / shape(F.lit(wavel0))


def gaussian_line(peak: Number, centre: Number, fwhm: Number, wavel: Column) -> Column:
    x = (wavel - col(centre)) / col(fwhm)
    return col(peak) * F.exp(x * x * (-4 * math.log(2)))


def lorentzian_line(peak: Number, centre: Number, fwhm: Number, wavel: Column) -> Column:
    x = (wavel - col(centre)) / col(fwhm)
    return col(peak) / (x * x * 4 + 1)


def inflate(sigma: Column, reference: Column | None = None, scale: Number | None = None, absolute: Number | None = None, relative: Number | None = None, combine: str = "quadrature") -> Column:
    """Errors scaled, then widened by an absolute and a relative term, in quadrature or as floors."""
    out = sigma if scale is None else sigma * col(scale)
    terms = [col(absolute)] if absolute is not None else []
    if relative is not None:
        terms.append(F.abs(reference) * col(relative))
    for t in terms:
        out = F.greatest(out, t) if combine == "max" else F.sqrt(out * out + t * t)
    return out


def flagged(value: Column, error: Column, flag: Column | None = None) -> Column:
    """Bad if flagged, not finite, or with an error not above zero."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    bad = odd(value) | odd(error) | (error <= 0)
    return bad if flag is None else F.coalesce(flag, F.lit(False)) | bad


def observable(cvis, kind: str) -> Column:
    """A complex visibility as squared visibility, amplitude or log amplitude."""
    return {"v2": cvis.abs2, "amp": cvis.abs, "logamp": lambda: F.log(cvis.abs2()) * 0.5}[kind]()


def transform_observed(v2: Column, error: Column, kind: str) -> tuple[Column, Column]:
    """A measured squared visibility and error as `kind`: sigma_f = |f'| sigma, null where it is not defined."""
    if kind == "v2":
        return v2, error
    good = F.when(v2 > 0, v2)
    root = F.sqrt(good)
    return (root, error / (root * 2)) if kind == "amp" else (F.log(root), error / (good * 2))
