"""The chi-square of images against visibilities from a lattice of pixel differences, without the visibilities.

For an image I on a square grid and gain g the chi-square is C - 2 g sum I D + g^2 sum A B: C is the weighted power of
the data, D the dirty image, B the beam at differences of pixels and A the autocorrelation of I at the same differences.
C, D and B are summed from the data once; each image then costs its own transform.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import MAS
from ..plans.work import Table
from .gridding import LINE_CELLS, sums_by_mode


@dataclass
class Lattice:
    """beam (by, dr, dc, beam) for differences within `shape` (rows, cols); cross (by, row, col, dirty); totals (by, c, n, log_weight)."""

    shape: tuple[int, int]
    by: tuple[str, ...]
    beam: Table
    cross: Table
    totals: Table

    @classmethod
    def of(cls, points: DataFrame, npix: int, scale: float, by: tuple[str, ...] = ("ddid",), shape: tuple[int, int] | None = None) -> Lattice:
        """Sums over `points` (by, u, v in wavelengths, re, im, weight) for images of npix x npix pixels of `scale` mas.

        Images that have no pixel beyond the rows and columns of `shape` need a lattice of these only, about the same
        middle. Points without u or v count as nothing; points of one baseline are summed first.
        """
        by = tuple(by)
        rows, cols = shape = shape or (npix, npix)
        points = points.where("u is not null and v is not null")
        whole = F.col("re").isNotNull() & F.col("im").isNotNull()
        w = F.when(whole, F.col("weight"))
        summed = points.groupBy(*by, "u", "v").agg(F.sum(w).alias("w"), F.sum(w * F.col("re")).alias("re"), F.sum(w * F.col("im")).alias("im"))
        summed = Table(summed, "lattice-points")
        ones = summed.df.select(*by, "u", "v", F.col("w").alias("re"), F.lit(0.0).alias("im"))
        beam = sums_by_mode(ones, (2 * rows, 2 * cols), scale, by).where(f"my > {-rows} and mx > {-cols}")
        beam = Table(beam.select(*by, F.col("my").alias("dr"), F.col("mx").alias("dc"), F.col("re").alias("beam")), "lattice-beam")
        # D at the middle offset of a pixel is a whole number of pixels from mode 0 once the phase of the rest is taken out
        off = lambda n: (npix - 1) / 2 - n // 2
        turn = (F.col("u") * off(cols) + F.col("v") * off(rows)) * (2 * math.pi * MAS * scale)
        re, im = F.col("re") * F.cos(turn) - F.col("im") * F.sin(turn), F.col("re") * F.sin(turn) + F.col("im") * F.cos(turn)
        shifted = summed.df.select(*by, "u", "v", re.alias("re"), im.alias("im"))
        # pixel (row, col) lies (half - col, half - row) from the middle: its mode is cols // 2 - col
        cross = sums_by_mode(shifted, (rows + 2, cols + 2), scale, by).withColumns({"row": rows // 2 - F.col("my"), "col": cols // 2 - F.col("mx")})
        inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
        cross = Table(cross.where(inside).select(*by, "row", "col", F.col("re").alias("dirty")), "lattice-cross")
        summed.drop()
        power = F.col("weight") * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))
        totals = points.groupBy(*by).agg(F.sum(power).alias("c"), F.count("*").alias("n"), F.sum(F.log("weight")).alias("log_weight"))
        return cls(shape, by, beam, cross, Table(totals, "lattice-totals"))

    def autocorrelation(self, images: DataFrame, key: str) -> DataFrame:
        """(key, dr, dc, a): sum of I(p) I(p + d) of every image, by transforms of its lines on a grid of twice its sides."""
        sizes = {"i": 2 * self.shape[0], "j": 2 * self.shape[1]}
        kind = dict(images.dtypes)[key]
        lines = f"`{key}` {kind}, i int, j int, re double, im double"

        def forward(place: str, line: str, inverse: bool):
            n = sizes[place]

            def task(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
                lines, row = np.unique(pdf[line].to_numpy(), return_inverse=True)
                dense = np.zeros((len(lines), n), complex)
                np.add.at(dense, (row, pdf[place].to_numpy() % n), pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy())
                z = np.fft.ifft(dense, axis=1) if inverse else np.fft.fft(dense, axis=1)
                return pd.DataFrame({key: [k[0]] * z.size, line: np.repeat(lines, n), place: np.tile(np.arange(n), len(lines)), "re": z.real.ravel(), "im": z.imag.ravel()})

            return task

        px = images.where("value is not null").select(key, F.col("row").cast("int").alias("i"), F.col("col").cast("int").alias("j"), F.col("value").cast("double").alias("re"), F.lit(0.0).alias("im"))
        for place, line, inverse in (("j", "i", False), ("i", "j", False), (None, None, None), ("j", "i", True), ("i", "j", True)):
            if place is None:
                px = px.select(key, "i", "j", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("re"), F.lit(0.0).alias("im"))
            else:
                block = F.floor(F.col(line) / max(1, LINE_CELLS // sizes[place])).alias("__block")
                px = px.groupBy(key, block).applyInPandas(forward(place, line, inverse), lines)
        signed = lambda c: F.when(F.col(c) < sizes[c] // 2, F.col(c)).otherwise(F.col(c) - sizes[c])
        return px.select(key, signed("i").alias("dr"), signed("j").alias("dc"), F.col("re").alias("a")).where(f"dr > {-self.shape[0]} and dc > {-self.shape[1]}")

    def chi2(self, images: DataFrame, key: str = "image", gain: float = 1.0) -> DataFrame:
        """(key, by, chi2, n) of every image (key, row, col, value) with every group of the data, by joins of what was summed.

        The lattice is as large as an image, so both joins are shuffled: a broadcast would pass it through the driver.
        """
        pairs = self.autocorrelation(images, key).join(self.beam.df.hint("merge"), ["dr", "dc"]).groupBy(key, *self.by).agg(F.sum(F.col("a") * F.col("beam")).alias("square"))
        dirty = images.select(key, "row", "col", F.col("value").cast("double").alias("value")).join(self.cross.df.hint("merge"), ["row", "col"])
        dirty = dirty.groupBy(key, *self.by).agg(F.sum(F.col("value") * F.col("dirty")).alias("linear"))
        both = pairs.join(dirty, [key, *self.by]).join(self.totals.df, list(self.by))
        chi2 = F.col("c") - F.col("linear") * (2.0 * gain) + F.col("square") * gain**2
        return both.select(key, *self.by, chi2.alias("chi2"), "n")

    def drop(self) -> None:
        for t in (self.beam, self.cross, self.totals):
            t.drop()
