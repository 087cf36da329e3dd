"""Operators against closed forms and small NumPy versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fringelake.functions import orbits as kepler
from fringelake.functions import special
from fringelake.operators import detection, imaging, joins, kernels, orbits, select, stats
from fringelake.plans import checks, grid, models
from fringelake.sources import fits, generated, oifits, records
from fringelake.streaming import sessions


def test_special_functions():
    assert special.ndtr(1.959963984540054) == pytest.approx(0.975, abs=1e-14)
    assert special.ndtri([1e-12, 0.5, 0.975]) == pytest.approx([-7.034483825301131, 0, 1.959963984540054], abs=1e-9)
    assert special.gammaincc(1.0, [0.0, 1.0, 30.0]) == pytest.approx([1, math.exp(-1), math.exp(-30)], rel=1e-12)
    # of a large shape: beside the median, as plain series with terms enough have it, and far out
    for a, x in ((50_000.0, 49_950.0), (300_000.0, 300_000.0), (300_000.0, 301_500.0)):
        term, total, n = 1 / a, 1 / a, 0
        while term > 1e-18 * total:
            n += 1
            term *= x / (a + n)
            total += term
        assert special.gammaincc(a, [x])[0] == pytest.approx(1 - total * math.exp(a * math.log(x) - x - math.lgamma(a)), abs=2e-9)
    assert special.gammaincc(18e6, [0.0, 18e6, 1e300]) == pytest.approx([1, 0.5 - 1 / (3 * math.sqrt(2 * math.pi * 18e6)), 0], abs=1e-9)
    assert special.chi2ppf([0.95], 1)[0] == pytest.approx(3.841458820694124, rel=1e-9)
    assert special.chi2ppf([0.95], 10)[0] == pytest.approx(18.307038053275146, rel=1e-9)
    low, high = special.clopper_pearson(0, 10)
    assert (low, high) == (0.0, pytest.approx(1 - 0.025**0.1, rel=1e-9))
    assert special.betaincinv(2, 3, 0.5) == pytest.approx(0.38572756813238945, rel=1e-9)


def column(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_bessel_columns(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (2.404825557695773,), (3.8317059702075125,), (10.0,)], "x double").select(special.j0(F.col("x")).alias("a"), special.j1(F.col("x")).alias("b"), special.jn(2, F.col("x")).alias("c")).collect()
    assert [r.a for r in rows] == pytest.approx([1, 0.7651976865579666, 0, -0.402759395702553, -0.2459357644513483], abs=5e-8)
    assert [r.b for r in rows] == pytest.approx([0, 0.44005058574493355, 0.5191474972894669, 0, 0.04347274616886144], abs=5e-8)
    assert rows[1].c == pytest.approx(0.1149034849319005, abs=1e-12)


MODELS = [
    models.PointSource(), models.GaussianDisk(sigma=2.0), models.EllipticalGaussian(fwhm=3.0, ratio=0.5, pa=30.0), models.UniformDisk(diam=4.0), models.LimbDarkenedDisk(diam=4.0, u=(0.3, 0.1)), models.Ring(radius=3.0, cos=(0.5,), sin=(0.1, 0.2)),
    models.Crescent(r_out=4.0, r_in=2.0, ecc=0.5), models.BinaryCartesian(x=10.0, y=5.0, ratio=0.1), models.BinaryAngular(sep=11.0, pa=63.0, ratio=0.1), models.Blurred(source=models.UniformDisk(diam=2.0), fwhm=1.0),
    models.System(parts=(models.PointSource(flux=0.4), models.Resolved(flux=0.6))), models.Rotated(source=models.BinaryCartesian(x=3.0, y=1.0, ratio=0.2), rotation=40.0),
]


@pytest.mark.parametrize("model", MODELS, ids=lambda m: type(m).__name__)
def test_models_at_zero_baseline_and_conjugate(spark, model):
    rows = spark.createDataFrame([(0.0, 0.0), (3e6, 1e6), (-3e6, -1e6)], "u double, v double")
    v = model.cvis(models.Uv(F.col("u"), F.col("v")))
    a, b, c = rows.select(v.re.alias("re"), v.im.alias("im")).collect()
    assert (a.re, a.im) == (pytest.approx(1, abs=1e-7), pytest.approx(0, abs=1e-12))
    assert (b.re, b.im) == (pytest.approx(c.re, abs=1e-9), pytest.approx(-c.im, abs=1e-9))


def test_limb_darkened_disk_without_darkening_is_uniform(spark):
    s = models.Uv(F.lit(3e7), F.lit(1e7))
    a, b = (m.cvis(s).re for m in (models.UniformDisk(diam=3.0), models.LimbDarkenedDisk(diam=3.0)))
    assert column(spark, a) == pytest.approx(column(spark, b), abs=2e-6)


def test_grid_blocks_are_one_pass(spark, monkeypatch, sf_dir):
    from fringelake.plans import derived

    samples, points = derived.samples(spark, sf_dir), grid.axes(spark, dra=[-5.0, 0.0, 5.0], ddec=[1.0, 2.0], flux=[0.1])
    model = models.BinaryCartesian(x="dra", y="ddec", ratio="flux")
    assert model.parameters() == {"dra", "ddec", "flux"}
    one = {r.point_id: r.loglike for r in grid.likelihood_grid(samples, points, model).collect()}
    monkeypatch.setattr(grid, "BLOCK", 2)
    many = {r.point_id: r.loglike for r in grid.likelihood_grid(samples, points, model).collect()}
    assert one.keys() == many.keys() == set(range(6)) and all(one[k] == pytest.approx(many[k]) for k in one)
    assert [(r.dra, r.ddec) for r in points.orderBy("point_id").collect()][:3] == [(-5.0, 1.0), (-5.0, 2.0), (0.0, 1.0)]


def test_bisection_column(spark):
    assert column(spark, grid.first_crossing(lambda m: m * m >= 2.0, F.lit(0.0), F.lit(4.0), 40)) == pytest.approx(math.sqrt(2))


def test_peaks(spark):
    rows = [(i, j, math.exp(-((i - 2) ** 2 + (j - 2) ** 2)) + 0.5 * math.exp(-((i - 7) ** 2 + (j - 6) ** 2))) for i in range(10) for j in range(10)]
    got = grid.peaks(spark.createDataFrame(rows, "ix int, iy int, score double"), list(range(10)), list(range(10)), 3.0, 3)
    assert [(x, y) for x, y, _ in got[:2]] == [(2, 2), (7, 6)]


def test_kepler(spark):
    orbit = kepler.Kepler(period=100.0, t_peri=10.0, ecc=0.6, inc=50.0, omega=60.0, Omega=120.0, a=20.0)
    rows = spark.createDataFrame([(10.0,), (60.0,), (33.3,)], "t double")
    x, y, e = orbit.plane(F.col("t"))
    got = rows.select(x.alias("x"), y.alias("y"), e.alias("e"), "t").collect()
    assert (got[0].x, got[0].y) == (pytest.approx(0.4), pytest.approx(0, abs=1e-12)) and got[1].x == pytest.approx(-1.6)
    assert got[2].e - 0.6 * math.sin(got[2].e) == pytest.approx(2 * math.pi * 0.233)
    t = orbit.thiele_innes()
    back = kepler.to_kepler(t["A"], t["B"], t["F"], t["G"])
    r = spark.range(1).select(*(v.alias(k) for k, v in back.items())).first()
    assert (r.a, r.inc, r.omega, r.Omega) == tuple(pytest.approx(v) for v in (20.0, 50.0, 60.0, 120.0))
    h = 1e-3
    assert column(spark, kepler.total_mass(F.lit(1000.0), F.lit(365.25), 1.0)) == pytest.approx(1.0, rel=1e-3)
    assert h > 0


def test_starting_orbits_recover_a_circle(spark):
    t = np.linspace(0, 900, 12)
    ep = [(float(x), 5 * math.sin(2 * math.pi * x / 400), 5 * math.cos(2 * math.pi * x / 400), 0.05) for x in t]
    trials = spark.createDataFrame([(i, p, 0.0, 0.0) for i, p in enumerate([300.0, 350.0, 400.0, 450.0])], "orbit_id long, period double, ecc double, t_peri double")
    best = orbits.starting_orbits(spark.createDataFrame(ep, "mjd double, dra double, ddec double, sigma double"), trials, 1).first()
    assert (best.period, best.A, best.G, best.chi2) == (400.0, pytest.approx(5), pytest.approx(5), pytest.approx(0, abs=1e-6))


def test_epochs_boundary_and_frames(spark):
    rows = spark.createDataFrame([(1, x) for x in (0.0, 0.5, 1.0, 1.6)], "k int, t double")
    assert [r.epoch for r in joins.epochs(rows, ["k"], "t", gap_days=0.5).orderBy("t").collect()] == [0, 0, 0, 1]
    assert [r.frame for r in joins.frames(rows, ["k"], "t", 0.5).orderBy("t").collect()] == [0, 0, 0, 1]


def test_split_triangles(spark):
    tri = spark.createDataFrame([(1, 1, 2, 3), (2, 3, 4, 5)], "tri_id int, s1 int, s2 int, s3 int")
    part = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b")], "sample_id int, part string")
    assert [r.tri_id for r in select.split_triangles(tri, part).collect()] == [2]


def test_whitening_is_the_dense_covariance():
    rng = np.random.default_rng(1)
    z, u = rng.normal(size=9), rng.normal(size=(9, 3))
    x, log_det = kernels.whiten_modes(z, u)
    cov = np.eye(9) + u @ u.T
    assert x @ x == pytest.approx(z @ np.linalg.solve(cov, z)) and log_det == pytest.approx(0.5 * np.linalg.slogdet(cov)[1])
    mean, post = kernels.mode_posterior(z, u)
    assert mean == pytest.approx(u.T @ np.linalg.solve(cov, z)) and post.shape == (3, 3)
    legs = np.array([[0, 3, 1], [0, 4, 2], [1, 5, 2], [3, 5, 4]])
    assert len(kernels.whiten_closures(rng.normal(size=4), np.ones(4), legs)) == 3
    assert kernels.closure_groups(np.array([[0, 1, 2], [2, 3, 4], [7, 8, 9]])).tolist() in ([0, 0, 1], [1, 1, 0])


def test_images(spark):
    a = imaging.ring(spark, 16, 1.0, 4.0, 1.0)
    b = imaging.gaussian_blob(spark, 16, 1.0, 2.0, dra=2.0)
    assert a.agg(F.sum("value")).first()[0] == pytest.approx(1) and b.agg(F.sum(F.col("dra") * F.col("value"))).first()[0] == pytest.approx(2, abs=0.01)
    assert imaging.resample(a, 1.0, 16, 8, 2.0).agg(F.sum("value")).first()[0] == pytest.approx(1)
    r = imaging.align(b, imaging.gaussian_blob(spark, 16, 1.0, 2.0), 3).first()
    assert (r.dr, r.dc) == (0, 2)
    both = a.select("pixel", F.col("value").alias("e")).join(a.select("pixel", F.col("value").alias("r")), "pixel").withColumn("k", F.lit(1))
    m = stats.image_metrics(both, ["k"], "e", "r").first()
    assert (m.ncc, m.rms, m.lawson) == (pytest.approx(1), pytest.approx(0), pytest.approx(0))
    assert stats.l1_score(both, ["k"], "e", "r").first().l1_score == pytest.approx(1)


def test_fap_and_bootstrap(spark):
    null = spark.createDataFrame([(float(i),) for i in range(99)], "x double")
    r = detection.false_alarm_probability(null, "x", 95.0).first()
    assert (r.k, r.n, r.fap) == (4, 99, 0.05) and r.low < 4 / 99 < r.high
    t = detection.threshold(null, "x", 0.1, n_boot=40).first()
    assert t.threshold == pytest.approx(88.2) and 0 < t.error < 10


def test_null_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(50).select(F.col("id").alias("sample_id"), F.lit(1.0).alias("error"), F.lit(2.0).alias("value"))
    a, b = (sorted(map(tuple, detection.gaussian_null(rows.repartition(n), F.lit(0.0), 5).select("draw", "sample_id", "value").collect())) for n in (1, 7))
    assert a == b and np.std([x[2] for x in a]) == pytest.approx(1, abs=0.2)


def oifits_bytes():
    wave = np.array([2.0e-6, 2.2e-6])
    sta = np.array([[0, 1], [2, 1], [0, 2]])
    vis2 = {"mjd": np.full(3, 6e4), "u": np.array([10.0, -20.0, 30.0]), "v": np.array([1.0, 2.0, 3.0]), "sta": sta, "value": np.array([[0.5, 0.6], [0.7, np.nan], [0.8, 0.9]]), "error": np.full((3, 2), 0.1)}
    t3 = {"mjd": np.array([6e4, 6e4 + 1]), "u1": [10.0, 10.0], "v1": [1.0, 1.0], "u2": [20.0, 20.0], "v2": [2.0, 2.0], "sta": np.array([[0, 1, 2], [0, 1, 2]]), "value": np.array([[0.1, 0.2], [0.3, 0.4]]), "error": np.full((2, 2), 0.05)}
    return oifits.build(wave, wave * 0.01, vis2, t3)


def test_oifits_round_trip(spark, tmp_path):
    (tmp_path / "a.fits").write_bytes(oifits_bytes())
    long = oifits.read_long(spark, str(tmp_path))
    assert {(r.kind, r.n) for r in long.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {("v2", 6), ("t3", 4), ("t3amp", 4)}
    o = oifits.observation(long)
    assert o["vis"].where("flag").count() == 1 and o["vis"].count() == 6
    # the second night's triangle has no visibilities, so its legs become samples of their own
    assert o["samples"].count() == 6 + 6 and o["triangles"].count() == 4
    tri = o["triangles"].orderBy("phi").first()
    assert tri.phi == pytest.approx(0.1, abs=1e-7) and None not in (tri.s1, tri.s2, tri.s3)


def test_fits_kinds():
    t = fits.Table("T", {"INSNAME": "it's"}, {"A": np.array([1.5, 2.5]), "B": np.array(["x", "long"], object), "C": np.array([[True, False], [False, True]]), "D": np.array([1, 2], np.int32)})
    (back,) = fits.read(fits.write([t]))
    assert back.header["INSNAME"] == "it's" and back.columns["B"].tolist() == ["x", "long"] and back.columns["C"].tolist() == [[True, False], [False, True]] and back.columns["D"].tolist() == [1, 2]


def test_generated_binary_is_found(spark):
    samples = generated.tracks(spark)
    assert samples.count() == 6 * 5 * 3
    scene = models.BinaryCartesian(x=6.0, y=-3.0, ratio=0.1)
    vis = generated.simulate(samples, scene, sigma=1e-4)
    points = grid.axes(spark, dra=[-6.0, 0.0, 6.0], ddec=[-3.0, 3.0], flux=[0.05, 0.1])
    best = grid.best_point(grid.likelihood_grid(samples.join(vis, "sample_id"), points, models.BinaryCartesian(x="dra", y="ddec", ratio="flux"))).join(points, "point_id").first()
    assert (abs(best.dra), best.flux, best.dra * best.ddec) == (6.0, 0.1, -18.0)  # V^2 cannot tell a binary from its mirror image


def test_stages_resume(spark, tmp_path):
    runs = []
    stage = lambda name, df: checks.Stage(name, lambda s, done: (runs.append(name), df(s, done))[1])
    stages = [stage("a", lambda s, d: s.range(3)), stage("b", lambda s, d: d["a"].where("id > 0"))]
    assert checks.run_stages(spark, stages, str(tmp_path), {"x": 1})["b"].count() == 2
    checks.run_stages(spark, stages, str(tmp_path), {"x": 1})
    assert runs == ["a", "b"]
    checks.run_stages(spark, stages, str(tmp_path), {"x": 2})
    assert runs == ["a", "b", "a", "b"]
    a, b = (checks.fingerprint(spark.range(100).repartition(n)).first() for n in (1, 9))
    assert a == b


def test_records(spark, tmp_path):
    cols = "setting double, fold int, score double"
    records.save_records(spark.createDataFrame([(1.0, 0, float("nan")), (1.0, 1, 2.0)], cols), str(tmp_path / "r"))
    assert sorted((r.fold, r.score) for r in records.load_records(spark, str(tmp_path / "r")).collect()) == [(0, None), (1, 2.0)]
    records.save_run(spark.range(2), str(tmp_path / "x"), {"seed": 1})
    records.save_run(spark.range(2), str(tmp_path / "y"), {"seed": 2})
    a, b = (spark.read.parquet(str(tmp_path / n)) for n in "xy")
    assert records.concatenate([a, a]).count() == 4
    with pytest.raises(ValueError):
        records.concatenate([a, b])


def test_streamed_sessions_are_the_batch_ones(spark, tmp_path):
    base = pd.Timestamp("2024-01-01")
    rows = [(k, (base + pd.Timedelta(seconds=s)).to_pydatetime()) for k in (1, 2) for s in (0, 5, 10, 31, 200)]
    spark.createDataFrame(rows, "k int, ts timestamp").write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9, (base + pd.Timedelta(days=1)).to_pydatetime())], "k int, ts timestamp").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "in"))
    q = sessions.session_epochs(stream, "k", "ts", "10 seconds").writeStream.outputMode("append").format("memory").queryName("sess").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.k, r.n) for r in spark.sql("select * from sess").collect())
    assert got == [(1, 1), (1, 1), (1, 3), (2, 1), (2, 1), (2, 3)]


def test_image_transform_in_blocks_and_off_the_lattice(spark, monkeypatch):
    import numpy as np

    from fringelake.functions.geometry import MAS
    from fringelake.operators import imaging

    rng = np.random.default_rng(3)
    px, uv = rng.normal(0, 5, (50, 3)), rng.normal(0, 3e7, (40, 2))
    image = spark.createDataFrame([tuple(map(float, p)) for p in px] + [(1.0, 1.0, None)], "dra double, ddec double, value double")
    rows = spark.createDataFrame([(i, float(u), float(v)) for i, (u, v) in enumerate(uv)] + [(99, None, 1.0)], "sample_id long, u double, v double")
    want = np.exp(-2j * np.pi * MAS * (uv[:, :1] * px[:, 0] + uv[:, 1:] * px[:, 1])) @ px[:, 2]
    for most in (imaging.PIXELS, 16):
        monkeypatch.setattr(imaging, "PIXELS", most)
        got = {r.sample_id: r for r in imaging.image_dft(image, rows).collect()}
        assert got[99].re is None and len(got) == 41
        assert np.allclose([got[i].re + 1j * got[i].im for i in range(40)], want, atol=1e-9)
    assert imaging.image_dft(image.limit(0), rows).where("re = 0 and im = 0").count() == 40


def test_ranks_do_not_depend_on_slices(spark, monkeypatch):
    import random

    from fringelake.plans import grid

    rng = random.Random(4)
    rows = [(i, rng.choice([1.0, 1.0, rng.random(), None, float("nan"), float("-inf")])) for i in range(500)]
    finite = lambda s: s is not None and s == s and abs(s) != float("inf")
    want = [i for i, s in sorted(rows, key=lambda r: (not finite(r[1]), -int(r[1] / 1e-3 + 0.5) if finite(r[1]) else 0, r[0]))]
    df = spark.createDataFrame(rows, "i long, score double")
    for sample in (grid.SAMPLE, 20):
        monkeypatch.setattr(grid, "SAMPLE", sample)
        got = grid.rank_scores(df, "score", "i").collect()
        assert [r.i for r in sorted(got, key=lambda r: r.rank)] == want and sorted(r.rank for r in got) == list(range(1, 501))
    assert grid.rank_scores(df.limit(0), "score", "i").collect() == []
