"""Gridding and the lattice of pixel differences against sums over every pixel and baseline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.operators import gridding, imaging
from fringelake.operators.lattice import Lattice

MAS, SCALE = gridding.MAS, 0.7
POINTS = "ddid int, u double, v double, re double, im double, weight double"


def image(spark, npix, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i // npix, i % npix, float(x)) for i, x in enumerate(rng.uniform(0, 1, npix * npix))]
    half = (npix - 1) / 2
    return spark.createDataFrame([(r, c, (half - c) * SCALE, (half - r) * SCALE, x) for r, c, x in rows], "row int, col int, dra double, ddec double, value double")


def points(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 5)) * [2e8, 2e8, 1, 1, 1]
    return spark.createDataFrame([(i % 3, *map(float, r[:4]), float(abs(r[4]) + 0.1)) for i, r in enumerate(z)], POINTS).repartition(3)


def test_the_kernel_of_a_whole_grid_sums_to_its_transform():
    n, which = 32, np.arange(-8, 8)
    for x in (0.0, 0.3, 17.77):
        cells, k = gridding._touched(np.array([x]), n)
        modes = np.exp(2j * np.pi * np.outer(which, cells[0]) / n) @ k[0] / gridding.kernel_modes(which, n)
        np.testing.assert_allclose(modes, np.exp(2j * np.pi * which * x / n), atol=1e-8)


@pytest.mark.parametrize("npix", [8, 9])
@pytest.mark.parametrize("cells", [gridding.CELLS, 0])
def test_visibilities_equal_the_exact_transform(spark, npix, cells):
    """Broadcast or joined, with baselines far beyond the grid's first turn, at nought, and missing."""
    px = image(spark, npix).withColumn("value", F.when((F.col("row") == 1) & (F.col("col") == 2), None).otherwise(F.col("value")))
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(40, 2)) * 3e8)] + [(90, 0.0, 0.0), (91, None, 1.0), (92, 1.0, None)]
    s = spark.createDataFrame(rows, "sample_id long, u double, v double").repartition(3)
    exact = {r.sample_id: (r.re, r.im) for r in imaging.image_dft(px, s).collect()}
    found = {r.sample_id: (r.re, r.im) for r in gridding.image_visibilities(px, s, npix, SCALE, cells=cells).collect()}
    assert found.keys() == exact.keys()
    for k, z in exact.items():
        assert found[k] == ((None, None) if z[0] is None else pytest.approx(z, abs=1e-7 * npix**2))


def test_sums_by_mode_by_group(spark):
    p = points(spark, 30)
    rows = gridding.sums_by_mode(p, 6, SCALE, ("ddid",)).collect()
    assert len(rows) == 3 * 36
    t = p.toPandas()
    for r in rows:
        q = t[t.ddid == r.ddid]
        z = np.sum((q.re + 1j * q.im) * np.exp(2j * np.pi * MAS * SCALE * (q.u * r.mx + q.v * r.my)))
        assert (r.re, r.im) == pytest.approx((z.real, z.imag), abs=1e-6)


@pytest.mark.parametrize("npix", [6, 7])
def test_the_lattice_gives_the_direct_chi_square(spark, npix):
    one = image(spark, npix)
    images = one.withColumn("image", F.lit(1)).unionByName(one.withColumns({"image": F.lit(2), "value": F.col("value") * 2 - 0.3}))
    p = points(spark, 45)
    lattice = Lattice.of(p, npix, SCALE)
    found = {(r.image, r.ddid): (r.chi2, r.n) for r in lattice.chi2(images, gain=0.9).collect()}
    t, px = p.toPandas(), images.toPandas()
    assert len(found) == 6
    for (k, d), (chi2, n) in found.items():
        q, i = t[t.ddid == d], px[px.image == k]
        model = np.exp(-2j * np.pi * MAS * (np.outer(q.u, i.dra) + np.outer(q.v, i.ddec))) @ i.value.to_numpy() * 0.9
        assert n == len(q) and chi2 == pytest.approx((q.weight * np.abs(q.re + 1j * q.im - model) ** 2).sum(), rel=1e-7)
    pixels = {(r.dr, r.dc): r.a for r in lattice.autocorrelation(images, "image").where("image = 1").collect()}
    v = one.toPandas().pivot(index="row", columns="col", values="value").to_numpy()
    for (a, b), x in pixels.items():
        direct = sum(v[i, j] * v[i + a, j + b] for i in range(npix) for j in range(npix) if 0 <= i + a < npix and 0 <= j + b < npix)
        assert x == pytest.approx(direct, abs=1e-9)
    lattice.drop()


@pytest.mark.parametrize("rows, cols", [(7, 3), (2, 6)])
def test_a_narrow_image_has_a_narrow_grid_about_the_same_middle(spark, rows, cols):
    npix = max(rows, cols)
    inside = (F.col("row") < rows) & (F.col("col") < cols)
    px, p = image(spark, npix).where(inside).withColumn("image", F.lit(1)), points(spark, 45)
    assert gridding.image_grid(px, (rows, cols)).count() == gridding.grid_size(rows) * gridding.grid_size(cols)
    s = p.select(F.monotonically_increasing_id().alias("sample_id"), "u", "v").localCheckpoint()
    wide, narrow = ({r.sample_id: (r.re, r.im) for r in gridding.image_visibilities(px, s, npix, SCALE, **k).collect()} for k in ({}, {"shape": (rows, cols)}))
    assert all(narrow[k] == pytest.approx(z, abs=1e-6) for k, z in wide.items())
    square, lattice = Lattice.of(p, npix, SCALE), Lattice.of(p, npix, SCALE, shape=(rows, cols))
    assert lattice.beam.df.count() == 3 * (2 * rows - 1) * (2 * cols - 1) and lattice.cross.df.count() == 3 * rows * cols
    found, want = ({r.ddid: r.chi2 for r in x.chi2(px, gain=0.9).collect()} for x in (lattice, square))
    assert found == pytest.approx(want, rel=1e-7)


def test_a_grid_of_some_megabytes_is_joined_and_not_broadcast():
    """The grid that passes through the driver stays under 8 MB: the parts' image at 60 times sf0.1 is joined."""
    assert gridding.CELLS * 16 < 8e6
    assert gridding.grid_size(6000) * gridding.grid_size(20) > gridding.CELLS
