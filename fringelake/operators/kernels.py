"""Small dense linear algebra per group, in Arrow-fed kernels: correlated closures, nuisance modes, posteriors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def incidence(legs: np.ndarray) -> np.ndarray:
    """T (triangles x baselines) with +1, +1, -1 on the legs of each triangle."""
    codes = np.unique(legs)
    out = np.zeros((len(legs), len(codes)))
    at = np.searchsorted(codes, legs)
    for k, sign in enumerate((1.0, 1.0, -1.0)):
        np.add.at(out, (np.arange(len(legs)), at[:, k]), sign)
    return out


def closure_groups(legs: np.ndarray) -> np.ndarray:
    """Label of each triangle: those that chains of shared samples connect are one group."""
    up: dict[int, int] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b, c in legs.tolist():
        up[find(b)] = find(a)
        up[find(c)] = find(a)
    return np.unique([find(a) for a in legs[:, 0].tolist()], return_inverse=True)[1]


def whiten_closures(residual: np.ndarray, sigma: np.ndarray, legs: np.ndarray) -> np.ndarray:
    """Independent unit-variance residuals of a group with covariance D^1/2 R D^1/2, R = T T^t / 3.

    R is singular where triangles close on each other; its null space is projected out.
    """
    t = incidence(legs)
    values, vectors = np.linalg.eigh(t @ t.T / 3)
    keep = values > 1e-9 * values.max()
    return (vectors[:, keep].T @ (residual / sigma)) / np.sqrt(values[keep])


def closure_norm(sigma: np.ndarray, legs: np.ndarray) -> float:
    """Half the log pseudo-determinant of a group's covariance: of R in its row space, and of D between its vectors."""
    t = incidence(legs)
    values, vectors = np.linalg.eigh(t @ t.T / 3)
    keep = values > 1e-9 * values.max()
    between = vectors[:, keep].T @ (sigma[:, None] ** 2 * vectors[:, keep])
    return 0.5 * float(np.log(values[keep]).sum() + np.linalg.slogdet(between)[1])


def closure_chi2(rows: DataFrame, group: str = "frame") -> DataFrame:
    """(group, chi2, penalty, log_norm, rank) of correlated closure residuals (residual, sigma, s1, s2, s3) of each group.

    chi2 is of the whitened sines, whose false minimum at half a turn the penalty removes: the sum of squares of
    (1 - cos r) / sigma. The log likelihood is -chi2 / 2 - penalty / 2 - log_norm - rank ln(2 pi) / 2. A group, which is
    a frame's triangles, is one row of lists; the groups of a batch whose legs meet alike are whitened together.
    """
    kind = dict(rows.dtypes)[group]
    triangles = F.sort_array(F.collect_list(F.struct("s1", "s2", "s3", "residual", "sigma")))
    lists = rows.groupBy(group).agg(triangles.alias("t")).select(group, *(F.col(f"t.{c}").alias(c) for c in ("s1", "s2", "s3", "residual", "sigma")))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            many = b.column("residual").value_lengths().to_numpy(zero_copy_only=False)
            start = np.cumsum(many) - many
            flat = {c: b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("s1", "s2", "s3", "residual", "sigma")}
            out = np.zeros((b.num_rows, 4))
            for m in np.unique(many).tolist():
                own = np.flatnonzero(many == m)
                at = start[own, None] + np.arange(m)
                legs = np.stack([flat[c][at] for c in ("s1", "s2", "s3")], axis=2).reshape(len(own), 3 * m)
                # samples by their rank in the group, so that groups whose legs meet alike are equal
                order = np.argsort(legs, axis=1, kind="stable")
                ranks = np.zeros(legs.shape, np.int64)
                np.put_along_axis(ranks, order, np.cumsum(np.diff(np.take_along_axis(legs, order, 1), axis=1, prepend=np.take_along_axis(legs, order, 1)[:, :1]) != 0, axis=1), 1)
                shapes, which = np.unique(ranks, axis=0, return_inverse=True)
                for k, shape in enumerate(shapes):
                    here = own[which.ravel() == k]
                    r, sigma = (flat[c][start[here, None] + np.arange(m)] for c in ("residual", "sigma"))
                    t = incidence(shape.reshape(m, 3))
                    values, vectors = np.linalg.eigh(t @ t.T / 3)
                    keep = values > 1e-9 * values.max()
                    z = (np.sin(r) / sigma) @ (vectors[:, keep] / np.sqrt(values[keep]))
                    between = np.einsum("ik,gi,il->gkl", vectors[:, keep], sigma**2, vectors[:, keep])
                    out[here] = np.stack([(z * z).sum(axis=1), ((2 * np.sin(r / 2) ** 2 / sigma) ** 2).sum(axis=1), 0.5 * (np.log(values[keep]).sum() + np.linalg.slogdet(between)[1]), np.full(len(here), keep.sum())], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(group), *(pa.array(out[:, i]) for i in range(3)), pa.array(out[:, 3].astype(np.int64))], [group, "chi2", "penalty", "log_norm", "rank"])

    return lists.mapInArrow(kernel, f"`{group}` {kind}, chi2 double, penalty double, log_norm double, rank long")


def closure_draws(rows: DataFrame, draws: int, group: str = "frame", id: str = "tri_id", seed: int = 0) -> DataFrame:
    """(group, id, draw, residual): closure residuals drawn from each group's covariance, by the seed and the group's ids.

    Draws lie in the covariance's own space: triangles that close on each other stay consistent.
    """

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id)
        t = incidence(pdf[["s1", "s2", "s3"]].to_numpy())
        rng = np.random.default_rng([seed, *(int(x) & 0xFFFFFFFF for x in pdf[id])])
        # each baseline's own noise, of a third of the variance, adds up to R along the legs
        x = pdf["sigma"].to_numpy()[:, None] * (t @ rng.normal(size=(t.shape[1], draws))) / np.sqrt(3)
        n = len(pdf)
        return pd.DataFrame({group: np.repeat(pdf[group].to_numpy(), draws), id: np.repeat(pdf[id].to_numpy(), draws), "draw": np.tile(np.arange(draws), n), "residual": x.ravel()})

    kinds = dict(rows.dtypes)
    return rows.select(group, id, "sigma", "s1", "s2", "s3").groupBy(group).applyInPandas(kernel, f"{group} {kinds[group]}, {id} {kinds[id]}, draw long, residual double")


def whiten_modes(x: np.ndarray, modes: np.ndarray) -> tuple[np.ndarray, float]:
    """x whitened for I + U U^t by one rank-one step a column, and half the log determinant."""
    x, u, log_det = np.array(x, float), np.array(modes, float), 0.0
    for k in range(u.shape[1]):
        a = u[:, k]
        n = a @ a
        if n <= 0:
            continue
        step = (1 - 1 / np.sqrt(1 + n)) / n
        x = x - a * (a @ x) * step
        u[:, k + 1 :] -= np.outer(a, a @ u[:, k + 1 :]) * step
        log_det += 0.5 * np.log1p(n)
    return x, log_det


def mode_posterior(x: np.ndarray, modes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of unit-prior weights of U in x = U w + unit noise."""
    precision = np.eye(modes.shape[1]) + modes.T @ modes
    cov = np.linalg.inv(precision)
    return cov @ (modes.T @ x), cov


def gain_loglike(rows: DataFrame, group: str, design: list[str]) -> DataFrame:
    """(group, loglike) of whitened residuals z with nuisance modes in the columns `design`, already scaled by width."""

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z, log_det = whiten_modes(pdf["z"].to_numpy(), pdf[design].to_numpy())
        return pd.DataFrame({group: [key[0]], "loglike": [float(-0.5 * z @ z - log_det - 0.5 * len(z) * np.log(2 * np.pi))]})

    kind = dict(rows.dtypes)[group]
    return rows.select(group, "z", *design).groupBy(group).applyInPandas(kernel, f"{group} {kind}, loglike double")


def each_task(tasks: DataFrame, run, schema: str) -> DataFrame:
    """`run(dict) -> list of dicts` over independent tasks, one row each, dealt to one partition a task."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [r for row in pdf.to_dict("records") for r in run(row)]
            if out:
                yield pd.DataFrame(out)

    return tasks.repartition(max(1, min(tasks.count(), 10_000))).mapInPandas(kernel, schema)
