"""Imaging sums over pixels and visibilities: weights, dirty maps, beams, regularisers, regridding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import MAS
from ..plans.grid import evaluate

#: Pixels of an image that are broadcast at once (24 MB), and complex numbers a kernel holds for a batch of baselines (64 MB).
PIXELS, LATTICE = 1 << 20, 1 << 22


def pixels(spark: SparkSession, npix: int, scale: float, value: Column | None = None) -> DataFrame:
    """(pixel, row, col, dra, ddec, value): row 0 north, column 0 east, offsets in mas."""
    half = (npix - 1) / 2
    out = spark.range(npix * npix).select(F.col("id").alias("pixel"), F.floor(F.col("id") / npix).cast("int").alias("row"), (F.col("id") % npix).cast("int").alias("col"))
    out = out.withColumns({"dra": (half - F.col("col")) * scale, "ddec": (half - F.col("row")) * scale})
    return out if value is None else out.withColumn("value", value)


def gaussian_blob(spark: SparkSession, npix: int, scale: float, sigma: float, dra: float = 0.0, ddec: float = 0.0) -> DataFrame:
    x, y = F.col("dra") - dra, F.col("ddec") - ddec
    raw = pixels(spark, npix, scale, F.exp((x * x + y * y) / (-2 * sigma * sigma)))
    return unit_sum(raw)


def ring(spark: SparkSession, npix: int, scale: float, radius: float, width: float, inc: float = 0.0, pa: float = 0.0, asymmetry: float = 0.0, asymmetry_pa: float = 0.0) -> DataFrame:
    a, c = math.radians(pa), math.cos(math.radians(inc))
    major = F.col("dra") * math.sin(a) + F.col("ddec") * math.cos(a)
    minor = (F.col("dra") * math.cos(a) - F.col("ddec") * math.sin(a)) / c
    r, angle = F.hypot(major, minor), F.atan2(F.col("dra"), F.col("ddec"))
    d = r - radius
    return unit_sum(pixels(spark, npix, scale, F.exp(d * d / (-2 * width * width)) * (F.cos(angle - math.radians(asymmetry_pa)) * asymmetry + 1.0)))


def unit_sum(image: DataFrame) -> DataFrame:
    total = image.agg(F.sum("value").alias("__total"))
    return image.crossJoin(F.broadcast(total)).withColumn("value", F.col("value") / F.col("__total")).drop("__total")


def imaging_weights(points: DataFrame, cell: float, weighting: str = "natural", robust: float = 0.5, taper_fwhm: float | None = None) -> DataFrame:
    """Add imaging_weight: natural, uniform or Briggs by uv cells folded to v >= 0, then a taper.

    Cell sums are grouped before they are joined back, so a crowded cell costs its task one row.
    """
    flip = F.when((F.col("v") < 0) | ((F.col("v") == 0) & (F.col("u") < 0)), -1.0).otherwise(1.0)
    out = points.withColumns({"__cu": F.floor(F.col("u") * flip / cell), "__cv": F.floor(F.col("v") * flip / cell)})
    w = F.col("weight")
    if weighting == "natural":
        new = w
    else:
        cells = out.groupBy("__cu", "__cv").agg(F.sum("weight").alias("__w"))
        out = out.join(cells, ["__cu", "__cv"])
        new = w / F.col("__w")
        if weighting == "briggs":
            every = cells.agg((F.sum(F.col("__w") * F.col("__w")) / F.sum("__w")).alias("__mean"))
            out = out.crossJoin(F.broadcast(every))
            new = w / (F.col("__w") * ((5 * 10**-robust) ** 2) / F.col("__mean") + 1.0)
    if taper_fwhm is not None:
        k = math.pi * taper_fwhm * MAS
        new = new * F.exp((F.col("u") * F.col("u") + F.col("v") * F.col("v")) * (-(k * k) / (4 * math.log(2))))
    return out.withColumn("imaging_weight", new).drop("__cu", "__cv", "__w", "__mean")


def _phase() -> Column:
    return (F.col("u") * F.col("dra") + F.col("v") * F.col("ddec")) * (2 * math.pi * MAS)


def dirty_map(points: DataFrame, grid: DataFrame, weight: str = "imaging_weight", beam: bool = False, n_pixels: int | None = None) -> DataFrame:
    """(pixel, value): sum w Re[V exp(2 pi i (u x + v y))] / sum w, or the beam with V = 1; pixels travel, points stay."""
    t = _phase()
    real = F.cos(t) if beam else F.col("re") * F.cos(t) - F.col("im") * F.sin(t)
    out = evaluate(points, grid.select("pixel", "dra", "ddec"), {"a": F.col(weight) * real, "b": F.col(weight)}, ("pixel",), n_pixels)
    return out.select("pixel", (F.col("a") / F.col("b")).alias("value"))


def _transform(shared):
    """Sums over a block of pixels for batches of baselines; trigonometry once per row and column where these are shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, value = shared.value
        (xs, at_x), (ys, at_y) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
        lattice = len(xs) * len(ys) <= 4 * len(value)
        if lattice:
            dense = np.zeros((len(ys), len(xs)))
            np.add.at(dense, (at_y, at_x), value)
        rows = max(1, LATTICE // max(1, len(xs) + len(ys) if lattice else len(value)))
        turn = -2j * math.pi * MAS
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                u, v = (b.column(i).to_numpy(zero_copy_only=False).astype(float)[:, None] for i in (1, 2))
                if lattice:
                    sums = ((np.exp(turn * v * ys) @ dense) * np.exp(turn * u * xs)).sum(1)
                else:
                    sums = np.exp(turn * (u * x + v * y)) @ value
                void = b.column(1).is_null().to_numpy(zero_copy_only=False) | b.column(2).is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums.real, mask=void), pa.array(sums.imag, mask=void)], ["id", "re", "im"])

    return run


def image_dft(image: DataFrame, samples: DataFrame, id: str = "sample_id") -> DataFrame:
    """(sample_id, re, im): exact transform of an image at every baseline (in wavelengths).

    The samples stay where they are and pass through an Arrow kernel. The pixels are counted: up to PIXELS are broadcast
    whole, a larger image in blocks by a hash of the position, whose sums are added by sample. Pixels without a value
    count as 0, a baseline without u or v has no transform.
    """
    spark = samples.sparkSession
    px = image.where("value is not null").select(*(F.col(c).cast("double").alias(c) for c in ("dra", "ddec", "value")))
    n = px.count()
    blocks = 1 if n <= PIXELS else -(-2 * n // PIXELS)  # half full on average, as a hash fills them unevenly
    kind = samples.schema[id].dataType.simpleString()
    out = None
    for i in range(blocks):
        held = (px if blocks == 1 else px.where(F.pmod(F.xxhash64("dra", "ddec"), F.lit(blocks)) == i)).toArrow()
        shared = spark.sparkContext.broadcast(tuple(held[c].to_numpy() for c in ("dra", "ddec", "value")))
        part = samples.select(F.col(id).alias("id"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")).mapInArrow(_transform(shared), f"id {kind}, re double, im double")
        out = part if out is None else out.union(part)
    if blocks > 1:
        out = out.groupBy("id").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return out.select(F.col("id").alias(id), "re", "im")


def beam(samples: DataFrame) -> DataFrame:
    """FWHM of the axes and position angle of the core of the beam, from weighted second moments of u, v (wavelengths)."""
    w, u, v = F.col("weight"), F.col("u") * MAS, F.col("v") * MAS
    m = samples.agg(*((F.sum(w * x) / F.sum(w)).alias(n) for n, x in (("uu", u * u), ("uv", u * v), ("vv", v * v))))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    k = 4 * math.pi**2
    a, b, c = F.col("vv") / det / k, -F.col("uv") / det / k, F.col("uu") / det / k
    mid, half = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + b * b)
    fwhm = math.sqrt(8 * math.log(2))
    pa = F.degrees(F.atan2(b * 2, c - a) / 2)
    return m.select((F.sqrt(mid + half) * fwhm).alias("major"), (F.sqrt(mid - half) * fwhm).alias("minor"), (pa - F.floor(pa / 180) * 180).alias("pa"))


def second_moment_fwhm(samples: DataFrame, v2_min: float = 0.3) -> DataFrame:
    """FWHM in mas of a Gaussian fitted to -ln V^2 on baselines (wavelengths) with V^2 of at least v2_min."""
    rho2 = F.col("u") * F.col("u") + F.col("v") * F.col("v")
    w = F.pow(F.col("value") / F.col("error"), 2.0)
    out = samples.where(F.col("value") >= v2_min).agg((F.sum(w * rho2 * -F.log("value")) / F.sum(w * rho2 * rho2)).alias("slope"))
    return out.select((F.sqrt(F.col("slope") * (2 * math.log(2))) / math.pi / MAS).alias("fwhm"))


def _steps(image: DataFrame, by: list[str]) -> DataFrame:
    """Add dx, dy: differences to the next column and the next row, 0 at the edge."""
    along = lambda p, o: F.coalesce(F.lead("value").over(Window.partitionBy(*by, p).orderBy(o)) - F.col("value"), F.lit(0.0))
    return image.withColumns({"dx": along("row", "col"), "dy": along("col", "row")})


def regularisers(image: DataFrame, by: list[str], epsilon: float = 0.01) -> DataFrame:
    """Raw penalty sums by image: squared differences, total variation, entropy against a flat prior, log sum, flux."""
    b = F.col("value")
    flux, n = F.sum("value").over(Window.partitionBy(*by)), F.count("*").over(Window.partitionBy(*by))
    s = _steps(image, by).withColumns({"__f": flux, "__n": n.cast("double")})
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    eps = F.col("__f") * epsilon / F.sqrt(F.col("__n"))
    return s.groupBy(*by).agg(
        F.sum(d2).alias("tsv"), F.sum(F.sqrt(d2 + eps * eps)).alias("tv"), F.sum(F.when(b > 0, b * F.log(b * F.col("__n") / F.col("__f"))).otherwise(0.0)).alias("entropy"),
        F.sum(F.log(b * F.col("__n") / F.col("__f") / epsilon + 1.0)).alias("log_sum"), F.sum(b).alias("flux"),
    )


def laplacian(image: DataFrame, by: list[str]) -> DataFrame:
    """Sum of the squared five-point stencil over the image padded with zeros, by scattering each pixel to its cross."""
    cross = F.explode(F.array(*(F.struct((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col"), (F.col("value") * c).alias("v")) for a, b, c in ((0, 0, -4.0), (1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)))))
    cells = image.select(*by, cross.alias("x")).select(*by, "x.*").groupBy(*by, "row", "col").agg(F.sum("v").alias("l"))
    return cells.groupBy(*by).agg(F.sum(F.col("l") * F.col("l")).alias("laplacian"))


def resample(image: DataFrame, scale: float, npix: int, new_npix: int, new_scale: float, by: tuple[str, ...] = ()) -> DataFrame:
    """An image on a new grid, flux shared by overlapping area; one row in, the few pixels it overlaps out."""

    def spans(i: Column, n: int, m: int) -> Column:
        lo, hi = (i - n / 2) * scale, (i - n / 2 + 1) * scale
        first, last = F.floor(lo / new_scale + m / 2), F.ceil(hi / new_scale + m / 2) - 1
        share = lambda j: F.struct(j.cast("int").alias("j"), (F.greatest(F.least(hi, (j - m / 2 + 1) * new_scale) - F.greatest(lo, (j - m / 2) * new_scale), F.lit(0.0)) / scale).alias("s"))
        return F.transform(F.sequence(first.cast("long"), F.greatest(last, first).cast("long")), share)

    out = image.select(*by, "value", F.explode(spans(F.col("row"), npix, new_npix)).alias("r"), spans(F.col("col"), npix, new_npix).alias("cs")).select(*by, "value", "r", F.explode("cs").alias("c"))
    inside = F.col("r.j").between(0, new_npix - 1) & F.col("c.j").between(0, new_npix - 1)
    return out.where(inside).groupBy(*by, F.col("r.j").alias("row"), F.col("c.j").alias("col")).agg(F.sum(F.col("value") * F.col("r.s") * F.col("c.s")).alias("value"))


def align(image: DataFrame, truth: DataFrame, max_shift: int) -> DataFrame:
    """The integer shift (dr, dc) of largest correlation; shifts are exploded and met by an equi-join on pixels."""
    s = F.sequence(F.lit(-max_shift), F.lit(max_shift))
    moved = image.select("value", "row", "col", F.explode(s).alias("dr")).select("*", F.explode(s).alias("dc")).select("dr", "dc", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), F.col("value").alias("e"))
    both = moved.join(truth.select("row", "col", F.col("value").alias("r")), ["row", "col"])
    return both.groupBy("dr", "dc").agg(F.corr("e", "r").alias("ncc")).orderBy(F.desc_nulls_last("ncc"), "dr", "dc").limit(1)


#: Taps of the cubic B-spline that smooths one scale of the starlet transform.
B3_SPLINE = (1 / 16, 1 / 4, 3 / 8, 1 / 4, 1 / 16)


def _smoothed(image: DataFrame, by: list[str], step: int) -> DataFrame:
    """`value` smoothed by the spline with taps `step` pixels apart, one axis at a time; zero beyond the image's pixels.

    `kept` goes along with its pixel: a pixel's own row carries it, taps carry none, and where no row does there is no
    pixel. So an axis is one shuffle and the image is read once.
    """
    kind = image.schema["kept"].dataType
    for axis, other in (("row", "col"), ("col", "row")):
        tap = lambda at, part, kept: F.struct(at.cast("int").alias(axis), part.alias("part"), kept.cast(kind).alias("kept"))
        taps = [tap(F.col(axis) + (k - 2) * step, F.col("value") * t, F.lit(None)) for k, t in enumerate(B3_SPLINE)]
        rows = image.select(*by, other, F.explode(F.array(*taps, tap(F.col(axis), F.lit(0.0), F.col("kept")))).alias("t"))
        sums = rows.groupBy(*by, other, F.col(f"t.{axis}").alias(axis)).agg(F.sum("t.part").alias("value"), F.max("t.kept").alias("kept"))
        image = sums.where("kept is not null").select(*by, "row", "col", "value", "kept")
    return image


def starlet(image: DataFrame, by: list[str], scales: int = 4) -> DataFrame:
    """(by, scale, row, col, value): detail planes from 0, finest first, and the rest as plane `scales`.

    All planes of a pixel travel in its row, so that the image is scanned once and shuffled twice a scale.
    """
    now = image.select(*by, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"), F.array().cast("array<double>").alias("planes"))
    for j in range(scales):
        kept = F.struct(F.col("value").alias("now"), F.col("planes").alias("planes"))
        smooth = _smoothed(now.select(*by, "row", "col", "value", kept.alias("kept")), by, 1 << j)
        now = smooth.select(*by, "row", "col", "value", F.concat(F.col("kept.planes"), F.array(F.col("kept.now") - F.col("value"))).alias("planes"))
    return now.select(*by, F.posexplode(F.concat("planes", F.array("value"))).alias("scale", "value"), "row", "col").select(*by, "scale", "row", "col", "value")


def starlet_l1(image: DataFrame, by: list[str], scales: int = 4, epsilon: float = 0.01) -> DataFrame:
    """(by, starlet_l1): sum of sqrt(s^2 + (epsilon / pixels)^2) over the detail planes."""
    size = image.groupBy(*by).agg(F.count("*").alias("pixels"))
    planes = starlet(image, by, scales).where(F.col("scale") < scales).join(size, by)
    return planes.groupBy(*by).agg(F.sum(F.sqrt(F.pow("value", 2.0) + F.pow(epsilon / F.col("pixels"), 2.0))).alias("starlet_l1"))


def centroid(image: DataFrame, by: list[str], nrow: int, ncol: int, scale: float, sigma: float | None = None) -> DataFrame:
    """(by, x, y): brightness-weighted offsets in mas from the centre (row 0 north, column 0 east), and with `sigma` half their squared whitened sum."""
    x, y = ((ncol - 1) / 2 - F.col("col")) * scale, ((nrow - 1) / 2 - F.col("row")) * scale
    out = image.groupBy(*by).agg(F.sum(F.col("value") * x).alias("x"), F.sum(F.col("value") * y).alias("y"))
    return out if sigma is None else out.withColumn("penalty", (F.pow("x", 2.0) + F.pow("y", 2.0)) / (2 * sigma**2))


def primary_beam(grid: DataFrame, freq_hz: float, dish_m: float, factor: float) -> DataFrame:
    """Pixels (dra, ddec in mas) with the log attenuation -4 ln 2 r^2 / FWHM^2, FWHM = factor c / (frequency dish)."""
    fwhm = factor * 299792458.0 / (freq_hz * dish_m) / MAS
    return grid.withColumn("log_beam", (F.pow("dra", 2.0) + F.pow("ddec", 2.0)) * (-4 * math.log(2) / fwhm**2))


def smearing_scale(samples: DataFrame) -> DataFrame:
    """The field in mas beyond which channel widths wash a source out: least wavel^2 / (bandwidth baseline); null without widths."""
    b = F.hypot("u", "v")
    return samples.where((b > 0) & (F.col("bandwidth") > 0)).agg(F.min(F.pow("wavel", 2.0) / (F.col("bandwidth") * b) / MAS).alias("smearing"))


def field_of_view(samples: DataFrame, largest: float = 500.0) -> DataFrame:
    """(pixel, field) in mas: half the finest fringe, and the least of `largest`, the coarsest fringe and the smearing field."""
    b = F.hypot("u", "v")
    finest, coarsest = F.min(F.when(b > 0, F.col("wavel") / b)), F.max(F.when(b > 0, F.col("wavel") / b))
    smear = F.min(F.when((b > 0) & (F.col("bandwidth") > 0), F.pow("wavel", 2.0) / (F.col("bandwidth") * b)))
    return samples.agg((finest / (2 * MAS)).alias("pixel"), F.least(F.lit(float(largest)), coarsest / MAS, smear / MAS).alias("field"))
