"""Fourier sums between an image and scattered baselines over a grid: a compact kernel and transforms by rows and columns.

A baseline touches WIDTH x WIDTH cells of a grid twice as fine as the image's own, whatever the number of pixels, and
the grid is transformed a line at a time, so that the cost is that of the baselines plus that of the image.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import MAS

#: Cells that a baseline touches along an axis; the error falls tenfold with each, and is about 1e-9 of the sum at 10.
WIDTH = 10
#: Steepness of the kernel for a grid twice as fine as the modes (Barnett, Magland and af Klinteberg 2019).
STEEP = 2.3 * WIDTH
#: Cells of a transformed image that are broadcast by way of the driver, 16 bytes each; a larger grid is joined.
CELLS = 1 << 18
#: Cells of the lines that are transformed in one call.
LINE_CELLS = 1 << 14


def kernel(z: np.ndarray) -> np.ndarray:
    """exp(b (sqrt(1 - z^2) - 1)) for |z| of at most 1."""
    return np.exp(STEEP * (np.sqrt(np.maximum(1 - z * z, 0)) - 1)) * (np.abs(z) <= 1)


def kernel_modes(modes: np.ndarray, n: int) -> np.ndarray:
    """The kernel's transform at whole modes of a grid of n cells, by quadrature."""
    z, w = np.polynomial.legendre.leggauss(4 * WIDTH + 20)
    return WIDTH / 2 * (np.cos(np.outer(modes, z) * (math.pi * WIDTH / n)) @ (w * kernel(z)))


def grid_size(modes: int) -> int:
    return 2 * (modes + modes % 2)


def _sides(modes: int | tuple[int, int]) -> tuple[int, int]:
    """Modes along rows and columns; a number stands for a square."""
    return (modes, modes) if isinstance(modes, int) else (int(modes[0]), int(modes[1]))


def _mode_range(modes: int) -> np.ndarray:
    return np.arange(modes) - modes // 2


def _touched(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (rows, WIDTH) of places x in cells, wrapped around, and the kernel there."""
    first = np.ceil(x - WIDTH / 2)
    cells = first[:, None] + np.arange(WIDTH)
    return np.mod(cells, n).astype(np.int64), kernel((cells - x[:, None]) / (WIDTH / 2))


def _places(batch: pa.RecordBatch, ny: int, nx: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the baselines along u and v; a mode is a step of one pixel."""
    at = lambda c, n: np.mod(batch.column(c).to_numpy(zero_copy_only=False).astype(float) * (MAS * scale * n), n)
    return at("u", nx), at("v", ny)


def spread(points: DataFrame, modes: int | tuple[int, int], scale: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, iy, ix, re, im): the numbers `re`, `im` at baselines u, v (wavelengths) on the grid for `modes` pixels of `scale` mas.

    Cells are summed in each batch and then by Spark, so what is shuffled is at most the grid for each batch of rows.
    Rows with a null among u, v, re and im count as nothing.
    """
    ny, nx = map(grid_size, _sides(modes))
    types = dict(points.dtypes)
    kind = "".join(f"`{b}` {types[b]}, " for b in by) + "iy int, ix int, re double, im double"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _places(b, ny, nx, scale)
            z = b.column("re").to_numpy(zero_copy_only=False) + 1j * b.column("im").to_numpy(zero_copy_only=False)
            (ix, kx), (iy, ky) = _touched(x, nx), _touched(y, ny)
            if by:
                keys = pd.DataFrame({c: b.column(c).to_pandas() for c in by})
                group = keys.groupby(list(by), dropna=False).ngroup().to_numpy()
                firsts = np.unique(group, return_index=True)[1]
            else:
                group = np.zeros(b.num_rows, np.int64)
            cell = ((group[:, None] * ny + iy)[:, :, None] * nx + ix[:, None, :]).ravel()
            value = ((ky * z[:, None])[:, :, None] * kx[:, None, :]).ravel()
            cells, at = np.unique(cell, return_inverse=True)
            re, im = np.bincount(at, value.real), np.bincount(at, value.imag)
            own = [b.column(c).take(pa.array(firsts[cells // (ny * nx)])) for c in by]
            yield pa.RecordBatch.from_arrays([*own, pa.array((cells // nx % ny).astype(np.int32)), pa.array((cells % nx).astype(np.int32)), pa.array(re), pa.array(im)], [*by, "iy", "ix", "re", "im"])

    whole = points.where("u is not null and v is not null and re is not null and im is not null").select(*by, *(F.col(c).cast("double").alias(c) for c in ("u", "v", "re", "im")))
    return whole.mapInArrow(task, kind).groupBy(*by, "iy", "ix").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def _lines(df: DataFrame, by: tuple[str, ...], line: str, place: str, out: str, size: int, modes: int, to_modes: bool) -> DataFrame:
    """Every line of a grid (one value of `line`) transformed along `place`; a line holds `size` numbers at most.

    Neighbouring lines of LINE_CELLS cells are transformed together.
    """
    types = dict(df.dtypes)
    kind = "".join(f"`{b}` {types[b]}, " for b in by) + f"{line} int, {out} int, re double, im double"
    which = _mode_range(modes)
    correction = kernel_modes(which, size)

    def task(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lines, row = np.unique(pdf[line].to_numpy(), return_inverse=True)
        dense = np.zeros((len(lines), size), complex)
        at = pdf[place].to_numpy()
        z = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        np.add.at(dense, (row, at % size), z if to_modes else z / correction[at + modes // 2])
        sums = np.fft.ifft(dense, axis=1) * size
        found = sums[:, which % size] / correction if to_modes else sums
        columns = {b: [k] * found.size for b, k in zip(by, key)}
        return pd.DataFrame(columns | {line: np.repeat(lines, found.shape[1]), out: np.tile(which if to_modes else np.arange(size), len(lines)), "re": found.real.ravel(), "im": found.imag.ravel()})

    block = F.floor(F.col(line) / max(1, LINE_CELLS // size)).alias("__block")
    return df.select(*by, line, place, "re", "im").groupBy(*by, block).applyInPandas(task, kind)


def sums_by_mode(points: DataFrame, modes: int | tuple[int, int], scale: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, my, mx, re, im): sum of z exp(2 pi i (u mx + v my)) over the points, for modes from -modes / 2 on, in pixels.

    `modes` is their number along an axis, or that of rows and that of columns.
    """
    rows, cols = _sides(modes)
    half = _lines(spread(points, modes, scale, by), by, "iy", "ix", "mx", grid_size(cols), cols, True)
    return _lines(half, by, "mx", "iy", "my", grid_size(rows), rows, True).select(*by, "my", "mx", "re", "im")


def image_grid(image: DataFrame, npix: int | tuple[int, int], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, iy, ix, re, im): an image (row, col, value) transformed to the fine grid, ready to be read at baselines."""
    rows, cols = _sides(npix)
    px = image.where("value is not null").select(*by, (F.col("row") - rows // 2).cast("int").alias("my"), (F.col("col") - cols // 2).cast("int").alias("mx"), F.col("value").cast("double").alias("re"), F.lit(0.0).alias("im"))
    half = _lines(px, by, "my", "mx", "ix", grid_size(cols), cols, False)
    return _lines(half, by, "ix", "my", "iy", grid_size(rows), rows, False).select(*by, "iy", "ix", "re", "im")


def _turn(npix: int, shape: tuple[int, int], scale: float, u: Column, v: Column) -> tuple[Column, Column]:
    """Cosine and sine of the phase between mode 0 and the middle of the image."""
    away = lambda n: (npix - 1) / 2 - n // 2
    phase = (u * away(shape[1]) + v * away(shape[0])) * (-2 * math.pi * MAS * scale)
    return F.cos(phase), F.sin(phase)


def image_visibilities(image: DataFrame, samples: DataFrame, npix: int, scale: float, id: str = "sample_id", cells: int = CELLS, shape: tuple[int, int] | None = None) -> DataFrame:
    """(id, re, im): the transform of an image (row, col, value) of npix x npix pixels at every baseline (wavelengths).

    As `imaging.image_dft` to about 1e-9 of the flux. The samples stay where they are if the grid, whose size is known
    beforehand, is of `cells` at most and is broadcast; a larger grid is joined to the cells that each sample touches.
    Pixels without a value count as 0, a baseline without u or v has no transform. `shape`, the rows and columns beyond
    which the image has no pixel, keeps the grid to these; the middle is that of npix x npix pixels all the same.
    """
    shape = _sides(shape or npix)
    (ny, nx), spark = map(grid_size, shape), samples.sparkSession
    fine = image_grid(image, shape)
    kind = samples.schema[id].dataType.simpleString()
    rows = samples.select(F.col(id).alias("id"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    if ny * nx <= cells:
        held = fine.toArrow()
        dense = np.zeros((ny, nx), complex)
        dense[held["iy"].to_numpy(), held["ix"].to_numpy()] = held["re"].to_numpy() + 1j * held["im"].to_numpy()
        shared = spark.sparkContext.broadcast(dense)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                void = b.column("u").is_null().to_numpy(zero_copy_only=False) | b.column("v").is_null().to_numpy(zero_copy_only=False)
                x, y = (np.nan_to_num(a) for a in _places(b, ny, nx, scale))
                (ix, kx), (iy, ky) = _touched(x, nx), _touched(y, ny)
                z = np.einsum("ri,rij,rj->r", ky, shared.value[iy[:, :, None], ix[:, None, :]], kx)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("u"), b.column("v"), pa.array(z.real, mask=void), pa.array(z.imag, mask=void)], ["id", "u", "v", "re", "im"])

        sums = rows.mapInArrow(task, f"id {kind}, u double, v double, re double, im double")
    else:
        sums = _joined(rows, fine, ny, nx, scale)
    c, s = _turn(npix, shape, scale, F.col("u"), F.col("v"))
    return sums.select(F.col("id").alias(id), (F.col("re") * c - F.col("im") * s).alias("re"), (F.col("re") * s + F.col("im") * c).alias("im"))


def _joined(rows: DataFrame, fine: DataFrame, ny: int, nx: int, scale: float) -> DataFrame:
    """Each baseline's sum over the cells it touches: an equi-join on the cell, whose crowded cells adaptive execution splits."""
    baselines = rows.where("u is not null and v is not null").select("u", "v").distinct()

    def along(c: str, n: int) -> Column:
        x = F.pmod(F.col(c) * (MAS * scale * n), F.lit(float(n)))
        first = F.ceil(x - WIDTH / 2)
        z = lambda k: (first + k - x) / (WIDTH / 2)
        weight = lambda k: F.exp((F.sqrt(F.greatest(1.0 - z(k) * z(k), F.lit(0.0))) - 1.0) * STEEP)
        return F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda k: F.struct(F.pmod(first + k, F.lit(n)).cast("int").alias("i"), weight(k).alias("w")))

    touched = baselines.select("u", "v", along("u", nx).alias("xs"), F.explode(along("v", ny)).alias("y")).select("u", "v", "y", F.explode("xs").alias("x"))
    touched = touched.select("u", "v", F.col("y.i").alias("iy"), F.col("x.i").alias("ix"), (F.col("x.w") * F.col("y.w")).alias("w"))
    sums = touched.join(fine, ["iy", "ix"]).groupBy("u", "v").agg(F.sum(F.col("w") * F.col("re")).alias("re"), F.sum(F.col("w") * F.col("im")).alias("im"))
    return rows.join(sums, ["u", "v"], "left")
