"""Fits, curvature and sampling: the driver moves parameters, Spark sums over the samples once a step."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grid
from .models import Component, samples_uv
from ..functions.photometry import observable


@dataclass(frozen=True)
class Fit:
    """Values at the optimum, their covariance (inverse curvature), chi2, steps made and whether it converged."""

    values: dict[str, float]
    covariance: np.ndarray
    chi2: float
    steps: int
    converged: bool


def _prediction(build: Callable[[dict], Component], values: dict[str, float], kind: str) -> Column:
    return observable(build(values).cvis(samples_uv()), kind)


def normal_equations(samples: DataFrame, build, values: dict[str, float], kind: str = "v2", step: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """(J^T J, J^T r, chi2) of whitened residuals, by central differences written as columns: one aggregate, no UDF."""
    names, err = list(values), F.col("error")
    r = (F.col("value") - _prediction(build, values, kind)) / err
    cols = []
    for n in names:
        h = step * max(1.0, abs(values[n]))
        up, down = (_prediction(build, values | {n: values[n] + s * h}, kind) for s in (1, -1))
        cols.append((up - down) / (2 * h) / err)
    rows = samples.select(r.alias("r"), *(c.alias(f"j{i}") for i, c in enumerate(cols)))
    sums = [F.sum(F.col(f"j{i}") * F.col(f"j{k}")).alias(f"a{i}_{k}") for i in range(len(names)) for k in range(i, len(names))]
    out = rows.agg(F.sum(F.col("r") * F.col("r")).alias("chi2"), *(F.sum(F.col(f"j{i}") * F.col("r")).alias(f"b{i}") for i in range(len(names))), *sums).first()
    a = np.zeros((len(names),) * 2)
    for i in range(len(names)):
        for k in range(i, len(names)):
            a[i, k] = a[k, i] = out[f"a{i}_{k}"]
    return a, np.array([out[f"b{i}"] for i in range(len(names))]), out["chi2"]


def fit(samples: DataFrame, build, start: dict[str, float], kind: str = "v2", bounds: dict[str, tuple[float, float]] | None = None, priors: dict[str, tuple[float, float]] | None = None, max_steps: int = 40, tol: float = 1e-8) -> Fit:
    """Levenberg-Marquardt; Gaussian priors (mean, sd) add to the normal equations, bounds clip each trial."""
    names, bounds, priors = list(start), bounds or {}, priors or {}

    def system(values):
        a, b, c = normal_equations(samples, build, values, kind)
        for i, n in enumerate(names):
            if n in priors:
                m, sd = priors[n]
                a[i, i] += 1 / sd**2
                b[i] += (m - values[n]) / sd**2
                c += ((m - values[n]) / sd) ** 2
        return a, b, c

    values, lam = dict(start), 1e-3
    a, b, chi2 = system(values)
    for step in range(1, max_steps + 1):
        move = np.linalg.solve(a + lam * np.diag(np.maximum(np.diag(a), 1e-300)), b)
        trial = {n: float(np.clip(values[n] + d, *bounds.get(n, (-np.inf, np.inf)))) for n, d in zip(names, move)}
        a2, b2, c2 = system(trial)
        if c2 <= chi2:
            done = chi2 - c2 <= tol * max(1.0, chi2)
            values, a, b, chi2, lam = trial, a2, b2, c2, lam / 5
            if done:
                return Fit(values, np.linalg.pinv(a), chi2, step, True)
        else:
            lam *= 8
            if lam > 1e12:
                return Fit(values, np.linalg.pinv(a), chi2, step, True)
    return Fit(values, np.linalg.pinv(a), chi2, max_steps, False)


def hessian(samples: DataFrame, build, values: dict[str, float], kind: str = "v2", step: float = 1e-3) -> np.ndarray:
    """Second derivatives of -log L by a grid of perturbed points: all of them in one pass over the samples."""
    names = list(values)
    h = np.array([step * max(1.0, abs(values[n])) for n in names])
    shifts = [(i, k, a, b) for i in range(len(names)) for k in range(i, len(names)) for a in (1, -1) for b in (1, -1)]
    points = []
    for p, (i, k, a, b) in enumerate(shifts):
        x = np.array([values[n] for n in names])
        x[i] += a * h[i]
        x[k] += b * h[k]
        points.append((p, *map(float, x)))
    table = samples.sparkSession.createDataFrame(points, "point_id long, " + ", ".join(f"{n} double" for n in names))
    ll = {r.point_id: r.loglike for r in grid.likelihood_grid(samples, table, build({n: n for n in names}), kind, n_points=len(points)).collect()}
    out = np.zeros((len(names),) * 2)
    for p, (i, k, a, b) in enumerate(shifts):
        out[i, k] -= a * b * ll[p] / (4 * h[i] * h[k])
    return out + np.triu(out, 1).T


def laplace_covariance(samples: DataFrame, build, values: dict[str, float], kind: str = "v2", ridge: float = 1e-10) -> np.ndarray:
    """Inverse of the observed information; where it is not positive definite, with a ridge on its diagonal."""
    m = hessian(samples, build, values, kind)
    scale = ridge * np.trace(np.abs(m)) / len(m)
    while np.linalg.eigvalsh(m).min() <= 0:
        m = m + np.eye(len(m)) * scale
        scale *= 10
    return np.linalg.inv(m)


def tempered_smc(samples: DataFrame, build, prior: dict[str, tuple[float, float]], n: int = 256, kind: str = "v2", seed: int = 0, ess_target: float = 0.5, moves: int = 3) -> tuple[dict[str, np.ndarray], float]:
    """(equally weighted draws, log evidence) under uniform priors (low, high), by adaptive tempering.

    The particles are the points of a grid: each likelihood is one pass of Spark over the samples for all of them.
    """
    rng, names = np.random.default_rng(seed), list(prior)
    low, high = (np.array([prior[p][i] for p in names]) for i in (0, 1))
    x = low + (high - low) * rng.random((n, len(names)))
    model, schema = build({p: p for p in names}), "point_id long, " + ", ".join(f"{p} double" for p in names)

    def loglike(x):
        table = samples.sparkSession.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], schema)
        out = np.empty(len(x))
        for r in grid.likelihood_grid(samples, table, model, kind, n_points=len(x)).collect():
            out[r.point_id] = r.loglike
        return np.where(((x >= low) & (x <= high)).all(1), out, -np.inf)

    ll, beta, log_z = loglike(x), 0.0, 0.0
    while beta < 1:
        ess = lambda d: (w := np.exp(d * (ll - ll.max()))).sum() ** 2 / (w * w).sum()
        if ess(1 - beta) >= ess_target * n:
            d = 1 - beta
        else:
            a, d = 0.0, 1 - beta
            for _ in range(60):
                m = (a + d) / 2
                a, d = (m, d) if ess(m) >= ess_target * n else (a, m)
        w = np.exp(d * (ll - ll.max()))
        log_z += d * ll.max() + math.log(w.mean())
        at = np.searchsorted(np.cumsum(w) / w.sum(), (rng.random() + np.arange(n)) / n)
        x, ll, beta = x[np.minimum(at, n - 1)], ll[np.minimum(at, n - 1)], beta + d
        root = np.linalg.cholesky(np.cov(x.T).reshape(len(names), -1) + 1e-18 * np.eye(len(names)))
        for _ in range(moves):
            y = x + (2.38 / math.sqrt(len(names))) * 0.5 * rng.normal(size=x.shape) @ root.T
            new = loglike(y)
            yes = np.log(rng.random(n)) < beta * (new - ll)
            x[yes], ll[yes] = y[yes], new[yes]
    return {p: x[:, i] for i, p in enumerate(names)}, log_z


def clean(points: DataFrame, npix: int, scale: float, gain: float = 0.1, minor: int = 100, major: int = 3, threshold: float = 0.0, weight: str = "imaging_weight") -> tuple[np.ndarray, np.ndarray]:
    """(model, residual): Hogbom minor cycles on the driver's maps, major cycles over all visibilities in Spark."""
    from ..operators import imaging

    spark = points.sparkSession
    pix, wide = imaging.pixels(spark, npix, scale), imaging.pixels(spark, 2 * npix - 1, scale)

    def image(df, n):
        out = np.zeros(n * n)
        for r in df.collect():
            out[r.pixel] = r.value
        return out.reshape(n, n)

    beam = image(imaging.dirty_map(points, wide, weight, beam=True, n_pixels=(2 * npix - 1) ** 2), 2 * npix - 1)
    model, left = np.zeros((npix, npix)), points
    residual = image(imaging.dirty_map(left, pix, weight, n_pixels=npix**2), npix)
    for _ in range(major):
        for _ in range(minor):
            i, k = np.unravel_index(np.argmax(np.abs(residual)), residual.shape)
            peak = residual[i, k]
            if abs(peak) <= threshold:
                break
            model[i, k] += gain * peak
            residual -= gain * peak * beam[npix - 1 - i : 2 * npix - 1 - i, npix - 1 - k : 2 * npix - 1 - k]
        at = np.flatnonzero(model)
        half = (npix - 1) / 2
        rows = [((half - p % npix) * scale, (half - p // npix) * scale, float(model.flat[p])) for p in at.tolist()]
        parts = spark.createDataFrame(rows, "dra double, ddec double, value double")
        seen = imaging.image_dft(parts, points.select("point_id", "u", "v"), "point_id").withColumnsRenamed({"re": "mre", "im": "mim"})
        left = points.join(seen, "point_id").withColumns({"re": F.col("re") - F.col("mre"), "im": F.col("im") - F.col("mim")})
        residual = image(imaging.dirty_map(left, pix, weight, n_pixels=npix**2), npix)
        if np.abs(residual).max() <= threshold:
            break
    return model, residual


def cross_validate(samples: DataFrame, settings: list[float], fit_and_score: Callable[[float, DataFrame, DataFrame], float], folds: int, fold: str = "fold") -> DataFrame:
    """Fold scores of every setting and their curve: `fit_and_score(setting, train, test)` runs Spark jobs itself."""
    from ..operators import select, stats

    rows = []
    for s in settings:
        for k in range(folds):
            train, test = select.fold_masks(samples, k, fold)
            rows.append((float(s), k, float(fit_and_score(s, train, test))))
    return stats.cv_curve(samples.sparkSession.createDataFrame(rows, "setting double, fold int, score double"))
