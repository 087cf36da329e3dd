"""CLEAN on tables: minor cycles on tiles of the map, residuals exact after each round, beams fitted and restored.

A round takes the pixels above the level that the beam's far sidelobes can fake, deals them into tiles, and lets every
tile's task find as many components as it can with the beam's inner patch. The residual is then the dirty map less the
model convolved with the whole beam, by transforms of lines, so that what tiles did not know of each other, and what the
patch left out, is put right before the next round. No map reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lattice import Lattice
from .work import Table

#: Side of a tile, components that a tile finds in a round at most (what is left comes in the next), and the beam's patch.
TILE, COMPONENTS, PATCH = 32, 2000, 12
_LINES = "i int, j int, re double, im double"


def _line(place: str, line: str, n: int, inverse: bool):
    """One line of a grid, transformed along `place`."""

    def task(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros(n, complex)
        np.add.at(dense, pdf[place].to_numpy() % n, pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy())
        z = np.fft.ifft(dense) if inverse else np.fft.fft(dense)
        return pd.DataFrame({line: int(key[0]), place: np.arange(n), "re": z.real, "im": z.imag})

    return task


def _transform(px: DataFrame, n: int, inverse: bool) -> DataFrame:
    """(i, j, re, im) transformed along both axes of an n x n grid, a line at a time."""
    for place, line in (("j", "i"), ("i", "j")):
        px = px.groupBy(line).applyInPandas(_line(place, line, n, inverse), _LINES)
    return px


def transformed(kernel: DataFrame, npix: int, value: str) -> DataFrame:
    """The transform of a kernel (dr, dc, value) of pixel differences, to convolve images of npix x npix pixels with."""
    n = 2 * npix
    wrapped = kernel.select(F.pmod("dr", F.lit(n)).cast("int").alias("i"), F.pmod("dc", F.lit(n)).cast("int").alias("j"), F.col(value).alias("re"), F.lit(0.0).alias("im"))
    return _transform(wrapped, n, False)


def convolved(image: DataFrame, kernel_transform: DataFrame, npix: int) -> DataFrame:
    """(row, col, value) of an image (row, col, value) convolved with a kernel, without wrapping around."""
    n = 2 * npix
    px = image.select(F.col("row").cast("int").alias("i"), F.col("col").cast("int").alias("j"), F.col("value").alias("re"), F.lit(0.0).alias("im"))
    k = kernel_transform.select("i", "j", F.col("re").alias("kr"), F.col("im").alias("ki"))
    both = _transform(px, n, False).join(k, ["i", "j"])
    product = both.select("i", "j", (F.col("re") * F.col("kr") - F.col("im") * F.col("ki")).alias("re"), (F.col("re") * F.col("ki") + F.col("im") * F.col("kr")).alias("im"))
    out = _transform(product, n, True).where(f"i < {npix} and j < {npix}")
    return out.select(F.col("i").alias("row"), F.col("j").alias("col"), F.col("re").alias("value"))


@dataclass(frozen=True)
class Beam:
    """FWHM of the axes in pixels and the position angle in degrees, from North (falling rows) to East (falling columns)."""

    major: float
    minor: float
    pa: float

    def kernel(self, spark, npix: int) -> DataFrame:
        """(dr, dc, value): the Gaussian of unit peak at all pixel differences."""
        side = 2 * npix - 1
        at = spark.range(side * side).select((F.floor(F.col("id") / side) - npix + 1).cast("int").alias("dr"), (F.col("id") % side - npix + 1).cast("int").alias("dc"))
        a, k = math.radians(self.pa), -4 * math.log(2)
        along, across = -F.col("dr") * math.cos(a) - F.col("dc") * math.sin(a), F.col("dr") * math.sin(a) - F.col("dc") * math.cos(a)
        return at.withColumn("value", F.exp((F.pow(along / self.major, 2.0) + F.pow(across / self.minor, 2.0)) * k))


def fit_beam(beam: DataFrame, least: float = 0.3) -> Beam:
    """The Gaussian of the main lobe (dr, dc, beam of peak 1): least squares of the logarithm, weighted by the beam, above `least`.

    The lobe is taken from the differences that lie within the first ring on which the beam falls below `least`.
    """
    r2 = F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")
    edge = beam.where(F.col("beam") < least).agg(F.min(r2)).first()[0]
    lobe = beam.where(F.col("beam") >= least).where(r2 < (edge if edge is not None else float("inf")))
    x, y, w = F.col("dc").cast("double"), F.col("dr").cast("double"), F.col("beam") * F.col("beam")
    terms = [x * x, x * y, y * y]
    sums = [F.sum(w * terms[i] * terms[j]).alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)] + [F.sum(w * terms[i] * F.log("beam")).alias(f"b{i}") for i in range(3)]
    s = lobe.agg(*sums).first()
    a = np.array([[s[f"a{min(i, j)}{max(i, j)}"] or 0.0 for j in range(3)] for i in range(3)])
    xx, xy, yy = np.linalg.lstsq(a, np.array([s[f"b{i}"] or 0.0 for i in range(3)]), rcond=None)[0]
    values, vectors = np.linalg.eigh(-np.array([[xx, xy / 2], [xy / 2, yy]]))
    if values[0] <= 0:
        raise ValueError("the main lobe is too narrow for the pixels to fit it")
    long = vectors[:, 0]  # the direction in which the beam falls most slowly, as (column, row)
    fwhm = np.sqrt(4 * math.log(2) / values)
    return Beam(float(fwhm[0]), float(fwhm[1]), float(np.degrees(np.arctan2(-long[0], -long[1])) % 180))


@dataclass
class Cleaned:
    """model and residual (row, col, value), in units of the dirty map's peak response, the beam (dr, dc, beam), and the rounds."""

    npix: int
    model: Table
    residual: Table
    beam: Table
    rounds: list[dict]

    def restored(self, beam: Beam | None = None) -> DataFrame:
        """(row, col, value): the model seen by a clean beam, by default that of the main lobe, and the residual."""
        spark = self.model.spark
        seen = convolved(self.model.df, transformed((beam or fit_beam(self.beam.df)).kernel(spark, self.npix), self.npix, "value"), self.npix)
        return self.residual.df.join(seen.withColumnRenamed("value", "seen"), ["row", "col"], "left").select("row", "col", (F.col("value") + F.coalesce("seen", F.lit(0.0))).alias("value"))


def _tile(gain: float, level: float, patch: np.ndarray):
    """Components of one tile: the largest candidate, again and again, with the beam's patch taken off the candidates."""
    half = patch.shape[0] // 2

    def task(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row, col, left = pdf["row"].to_numpy(), pdf["col"].to_numpy(), pdf["value"].to_numpy().copy()
        found: dict[int, float] = {}
        for _ in range(COMPONENTS):
            k = int(np.abs(left).argmax())
            if abs(left[k]) <= level:
                break
            flux = gain * left[k]
            found[k] = found.get(k, 0.0) + flux
            dr, dc = row - row[k], col - col[k]
            near = (np.abs(dr) <= half) & (np.abs(dc) <= half)
            left[near] -= flux * patch[dr[near] + half, dc[near] + half]
        at = np.array(list(found), int)
        return pd.DataFrame({"row": row[at], "col": col[at], "value": [found[k] for k in found]})

    return task


def clean(points: DataFrame, npix: int, scale: float, gain: float = 0.1, threshold: float = 0.0, rounds: int = 20, patch: int = PATCH, tile: int = TILE, weight: str = "imaging_weight") -> Cleaned:
    """Components of the sky from visibilities (u, v in wavelengths, re, im, `weight`), until no pixel is above `threshold`.

    A round stops at the level of the largest far sidelobe times the peak, or at the threshold; tiles know only of
    their own pixels in a round. Rounds end after `rounds`, or when one no longer lowers the peak.
    """
    lattice = Lattice.of(points.withColumn("weight", F.col(weight)), npix, scale, by=())
    total = lattice.beam.df.where("dr = 0 and dc = 0").first()["beam"]
    beam = Table(lattice.beam.df.withColumn("beam", F.col("beam") / total), "clean-beam")
    dirty = Table(lattice.cross.df.select("row", "col", (F.col("dirty") / total).alias("value")), "clean-dirty")
    lattice.drop()
    seen = Table(transformed(beam.df, npix, "beam"), "clean-transform")
    inner = beam.df.where(f"abs(dr) <= {patch} and abs(dc) <= {patch}").toPandas()
    held = np.zeros((2 * patch + 1,) * 2)
    held[inner["dr"] + patch, inner["dc"] + patch] = inner["beam"]
    far = beam.df.where(f"abs(dr) > {patch} or abs(dc) > {patch}").agg(F.max(F.abs("beam"))).first()[0] or 0.0
    model = Table(dirty.df.where("false"), "clean-model")
    residual, record = dirty, []
    for _ in range(rounds):
        peak = residual.df.agg(F.max(F.abs("value"))).first()[0] or 0.0
        if peak <= threshold or (record and peak >= record[-1]["peak"]):
            break
        level = max(threshold, min(far, 0.9) * peak, 0.1 * peak)
        chosen = residual.df.where(F.abs("value") > level)
        parts = chosen.groupBy(F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc")).applyInPandas(_tile(gain, level, held), "row int, col int, value double")
        after = Table(model.df.unionByName(parts).groupBy("row", "col").agg(F.sum("value").alias("value")), "clean-model")
        model.drop()
        model = after
        off = convolved(model.df, seen.df, npix).withColumnRenamed("value", "off")
        new = Table(dirty.df.join(off, ["row", "col"]).select("row", "col", (F.col("value") - F.col("off")).alias("value")), "clean-residual")
        if residual is not dirty:
            residual.drop()
        residual = new
        record.append({"peak": peak, "level": level})
    seen.drop()
    return Cleaned(npix, model, residual, beam, record)
