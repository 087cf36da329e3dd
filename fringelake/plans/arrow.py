"""Marginal likelihoods of residuals with nuisances of their block and nuisances that span all blocks.

The covariance is s^2 I + U U^t. A column of U belongs to one block (a station's gain in a frame) or spans the data (a
calibration scale). Gram sums of a block are sums over its rows, combined before the shuffle; every block is then
eliminated by itself, and what the blocks leave is a matrix as large as there are spanning columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Table

#: Blocks whose solution is broadcast when residuals are formed.
FEW = 1_000_000


def _block_matrices(entries, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Modes of a block, their Gram matrix, and products with the k spanning columns and the residual (last)."""
    i, j, v = (np.array([e[c] for e in entries]) for c in ("i", "j", "v"))
    modes = np.unique(i)
    at = np.searchsorted(modes, i)
    gram, side = np.zeros((len(modes),) * 2), np.zeros((len(modes), k + 1))
    own = j >= 0
    to = np.searchsorted(modes, j[own])
    gram[at[own], to] = v[own]
    gram[to, at[own]] = v[own]
    side[at[~own], -1 - j[~own]] = v[~own]
    return modes, gram, side


@dataclass
class Arrow:
    """Gram sums of the blocks, and of the spanning columns and the residual over all rows."""

    rows: DataFrame
    blocks: Table
    spanning: tuple[str, ...]
    total: np.ndarray
    n: int

    @classmethod
    def of(cls, rows: DataFrame, x: str = "x", block: str = "block", modes: str = "modes", spanning: tuple[str, ...] = ()) -> Arrow:
        """From rows with a residual x (whitened at s = 1), a block, its `modes` (array of mode, value), and spanning columns.

        A mode names a column of its block and a row lists those that are not nought; rows without a block, or with no
        modes, count in the spanning columns alone.
        """
        k = len(spanning)
        held = rows.select(F.col(x).alias("x"), F.col(block).alias("block"), F.col(modes).alias("modes"), *spanning)
        side = [F.col(c) for c in (*spanning, "x")]
        whole = held.agg(F.count("*").alias("n"), *[F.sum(side[a] * side[b]).alias(f"g{a}_{b}") for a in range(k + 1) for b in range(a, k + 1)]).first()
        total = np.zeros((k + 1,) * 2)
        for a in range(k + 1):
            for b in range(a, k + 1):
                total[a, b] = total[b, a] = whole[f"g{a}_{b}"] or 0.0
        pair = lambda i, j, v: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), v.cast("double").alias("v"))
        own = F.flatten(F.transform("modes", lambda a: F.transform(F.filter("modes", lambda b: b["mode"] >= a["mode"]), lambda b: pair(a["mode"], b["mode"], a["value"] * b["value"]))))
        other = F.flatten(F.transform("modes", lambda a: F.array(*[pair(a["mode"], F.lit(-1 - c), a["value"] * side[c]) for c in range(k + 1)])))
        pairs = held.where("block is not null").select("block", F.explode(F.concat(own, other)).alias("e"))
        sums = pairs.groupBy("block", F.col("e.i").alias("i"), F.col("e.j").alias("j")).agg(F.sum("e.v").alias("v"))
        return cls(held, Table(sums.groupBy("block").agg(F.collect_list(F.struct("i", "j", "v")).alias("entries")), "arrow"), tuple(spanning), total, whole["n"])

    def _reduced(self, scale2: float) -> tuple[np.ndarray, float, int]:
        """What is left of the spanning sums once every block is eliminated, half the log determinants, columns."""
        k = len(self.spanning)

        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            left, log_det, count = np.zeros((k + 1, k + 1)), 0.0, 0
            for pdf in frames:
                for entries in pdf["entries"]:
                    _, gram, side = _block_matrices(entries, k)
                    chol = np.linalg.cholesky(gram + scale2 * np.eye(len(gram)))
                    half = np.linalg.solve(chol, side)
                    left += half.T @ half
                    log_det += float(np.log(np.diag(chol)).sum())
                    count += len(gram)
            yield pd.DataFrame({"at": [*range((k + 1) ** 2), -1, -2], "v": [*left.ravel(), log_det, count]})

        sums = {r["at"]: r["v"] for r in self.blocks.df.select("entries").mapInPandas(task, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
        left = np.array([sums.get(i, 0.0) for i in range((k + 1) ** 2)]).reshape(k + 1, k + 1)
        return self.total - left, sums.get(-1, 0.0), int(sums.get(-2, 0))

    def at(self, scale2: float = 1.0) -> dict[str, float]:
        """chi2 (of the whole covariance), norm (half log det (I + U^t U / s^2)) and the log likelihood."""
        left, log_det, count = self._reduced(scale2)
        k = len(self.spanning)
        schur = left[:k, :k] + scale2 * np.eye(k)
        chol = np.linalg.cholesky(schur)
        half = np.linalg.solve(chol, left[:k, k])
        chi2 = (left[k, k] - half @ half) / scale2
        norm = log_det + float(np.log(np.diag(chol)).sum()) - 0.5 * (count + k) * math.log(scale2)
        return {"chi2": float(chi2), "norm": norm, "loglike": float(-0.5 * chi2 - norm - 0.5 * self.n * math.log(2 * math.pi * scale2))}

    def weights(self, scale2: float = 1.0) -> tuple[DataFrame, np.ndarray]:
        """The nuisances' conditional means: (block, mode, weight), and those of the spanning columns."""
        left, _, _ = self._reduced(scale2)
        k = len(self.spanning)
        span = np.linalg.solve(left[:k, :k] + scale2 * np.eye(k), left[:k, k])
        kind = dict(self.blocks.df.dtypes)["block"]

        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out = []
                for block, entries in zip(pdf["block"], pdf["entries"], strict=True):
                    modes, gram, side = _block_matrices(entries, k)
                    y = np.linalg.solve(gram + scale2 * np.eye(len(gram)), side[:, k] - side[:, :k] @ span)
                    out += [(block, int(m), float(w)) for m, w in zip(modes, y, strict=True)]
                yield pd.DataFrame(out, columns=["block", "mode", "weight"])

        return self.blocks.df.mapInPandas(task, f"block {kind}, mode int, weight double"), span

    def residual_power(self, scale2: float = 1.0) -> dict[str, float]:
        """chi2 as |x - U y|^2 / s^2 + |y|^2 and r2 = |x - U y|^2, from residuals formed in the rows.

        The sums of `at` lose digits where nuisances are far wider than the noise; this reads the rows once more and
        loses none. The weights are broadcast if counted to be few, and joined by their block otherwise.
        """
        weights, span = self.weights(scale2)
        kept = Table(weights.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("mode", "weight"))).alias("y")), "arrow-weights")
        side = F.broadcast(kept.df) if kept.df.count() <= FEW else kept.df
        fit = F.coalesce(F.aggregate("modes", F.lit(0.0), lambda s, m: s + m["value"] * F.coalesce(F.try_element_at("y", m["mode"]), F.lit(0.0))), F.lit(0.0))
        for c, y in zip(self.spanning, span, strict=True):
            fit = fit + F.col(c) * float(y)
        r2 = self.rows.join(side, "block", "left").agg(F.sum(F.pow(F.col("x") - fit, 2.0))).first()[0] or 0.0
        y2 = kept.df.select(F.explode(F.map_values("y")).alias("w")).agg(F.sum(F.col("w") * F.col("w"))).first()[0] or 0.0
        kept.drop()
        return {"chi2": r2 / scale2 + y2 + float(span @ span), "r2": r2}

    def drop(self) -> None:
        self.blocks.drop()


def station_modes(width: float, model: str = "model", error: str = "error", stations: tuple[str, str] = ("station_a", "station_b")):
    """The modes of a baseline's squared visibility for log gains of its two stations, each of prior width `width`.

    A log gain g of a station multiplies the amplitude, so that the squared visibility changes by 2 g times itself.
    """
    value = F.col(model) * (2.0 * width) / F.col(error)
    return F.array(*(F.struct(F.col(s).cast("int").alias("mode"), value.alias("value")) for s in stations))
