"""Closure phases in the likelihood: bispectra of models, and residuals on the circle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cx import Cx
from ..functions.geometry import wrap_phase
from . import grid
from .models import Component, Uv


def triangle_rows(triangles: DataFrame, samples: DataFrame) -> DataFrame:
    """Triangles (tri_id, s1, s2, phi, d_phi) with the baselines of their first two legs, in metres; the third closes them.

    The legs are joined by their sample ids, one equi-join each; a triangle whose legs are missing is an error for the
    caller to count, as it has no row here.
    """
    leg = lambda k: samples.select(F.col("sample_id").alias(f"s{k}"), F.col("u").alias(f"u{k}"), F.col("v").alias(f"v{k}"), *([F.col("wavel")] if k == 1 else []))
    return triangles.join(leg(1), "s1").join(leg(2), "s2")


def bispectrum(model: Component) -> Cx:
    """V(1) V(2) conj V(1 + 2) of a row with u1, v1, u2, v2 and wavel."""
    w = F.col("wavel")
    u1, v1, u2, v2 = (F.col(c) / w for c in ("u1", "v1", "u2", "v2"))
    at = lambda u, v: model.cvis(Uv(u, v, w))
    return at(u1, v1) * at(u2, v2) * at(u1 + u2, v1 + v2).conj()


def residual(model: Component, phase: str = "phi") -> Column:
    """Model less data, wrapped to (-pi, pi]."""
    return wrap_phase(bispectrum(model).arg() - F.col(phase))


def chi2_terms(model: Component, kind: str = "chord", phase: str = "phi", error: str = "d_phi") -> Column:
    """One closure phase's squared whitened residual: of the angle (`linear`), or of the chord 2 sin(r / 2).

    The chord is also the sine with its penalty row, as sin(r)^2 + (2 sin(r / 2)^2)^2 is its square.
    """
    r = residual(model, phase)
    r = r if kind == "linear" else F.sin(r / 2) * 2.0
    return F.pow(r / F.col(error), 2.0)


def closure_likelihood_grid(rows: DataFrame, points: DataFrame, model: Component, kind: str = "chord", n_points: int | None = None) -> DataFrame:
    """(point_id, loglike) of every point over the closure phases of `triangle_rows`."""
    out = grid.evaluate(rows, points, {"chi2": chi2_terms(model, kind)}, n_points=n_points)
    return out.select("point_id", (F.col("chi2") * -0.5).alias("loglike"))


def joint(*grids: DataFrame) -> DataFrame:
    """The sum of independent log likelihoods (point_id, loglike) over datasets."""
    out = grids[0].select("point_id", "loglike")
    for g in grids[1:]:
        out = out.unionByName(g.select("point_id", "loglike"))
    return out.groupBy("point_id").agg(F.sum("loglike").alias("loglike"))


def flux_uncertainty(likelihoods: DataFrame, by: list[str], step: float) -> DataFrame:
    """One-sigma flux width from log likelihoods at flux - step, flux and flux + step (`side` -1, 0, 1); null if not curved."""
    at = lambda k: F.max(F.when(F.col("side") == k, F.col("loglike")))
    curve = (at(-1) + at(1) - 2.0 * at(0)) / step**2
    return likelihoods.groupBy(*by).agg(curve.alias("curve")).select(*by, F.when(F.col("curve") < 0, 1.0 / F.sqrt(-F.col("curve"))).alias("sigma_flux"))
