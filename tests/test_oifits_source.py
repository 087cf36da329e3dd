"""The OIFITS data source: round trips of every observable, pushed filters, exposures and extras on samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.sources import oifits_source as source


def long_rows(spark):
    rng, rows = np.random.default_rng(0), []
    for file in ("a.fits", "b.fits"):
        for target in ("HD 1", "HD 2"):
            for r in range(4):
                base = dict(file=file, insname="INS", target=target, mjd=60000.0 + r * 0.01, time=float(r), exposure=10.0)
                for kind in ("v2", "amp", "phi", "t3", "t3amp", "flux"):
                    sta = (1, 2, 3) if kind.startswith("t3") else (2, -1, -1) if kind == "flux" else ((2, 1, -1) if kind in ("amp", "phi") and r == 2 else (1, 2, -1))
                    for ch in range(3):
                        u = (np.nan, np.nan) if kind == "flux" else (10.0 + r, -5.0)
                        u2 = (3.0, 4.0) if kind.startswith("t3") else (np.nan, np.nan)
                        row = r + (4 if target == "HD 2" else 0)
                        rows.append((file, kind, "INS", row, ch, 1.6e-6 + ch * 1e-7, 1e-8, base["mjd"], base["time"], 10.0, *sta, *map(float, u), *map(float, u2), float(rng.normal()), float(rng.uniform(0.1, 1)), bool(rng.integers(2)) if kind in ("v2", "flux") else False, target))
    return spark.createDataFrame(rows, source.ROW)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("oifits") / "out")
    rows = long_rows(spark)
    done = source.write(rows, path).collect()
    assert sorted(r.file for r in done) == ["a.fits", "b.fits"] and {r.rows for r in done} == {144}
    source.register(spark)
    return path, rows


def keyed(df):
    return {(r.file.rsplit("/")[-1], r.kind, r.target, r.row, r.channel): r for r in df.collect()}


def test_every_observable_comes_back(spark, written):
    path, rows = written
    found, want = keyed(spark.read.format("oifits").load(path)), keyed(rows)
    assert found.keys() == want.keys()
    for k, w in want.items():
        r = found[k]
        for c in ("wavel", "bandwidth", "mjd", "time", "exposure", "u", "v", "u2", "v2", "value", "error"):
            assert getattr(r, c) == (None if np.isnan(getattr(w, c)) else pytest.approx(getattr(w, c), rel=1e-12)), c
        assert (r.sta1, r.sta2, r.sta3, r.flag) == (w.sta1, w.sta2, w.sta3, w.flag)


def test_filters_are_pushed_into_the_files(spark, written):
    path, rows = written
    asked = "target = 'HD 2' and kind in ('phi', 't3') and channel > 0"
    df = spark.read.format("oifits").option("pushdown", "true").load(path).where(asked)
    assert keyed(df).keys() == keyed(rows.where(asked)).keys()
    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    # only the filter on the channel, and that a target is there, is left to Spark
    left = [x for x in plan.splitlines() if x.startswith("Condition")]
    assert left and not any("HD 2" in x or "kind" in x for x in left)
    assert spark.read.format("oifits").option("pushdown", "true").load(f"{path}/a.fits").where("target = 'none'").count() == 0


def test_a_frame_that_is_filtered_in_two_ways_keeps_both(spark, written):
    long = spark.read.format("oifits").load(written[0])
    both = long.where("kind = 'v2'").union(long.where("kind = 'phi'"))
    assert {r.kind: r["count"] for r in both.groupBy("kind").count().collect()} == {"v2": 48, "phi": 48}


def test_a_reader_takes_what_it_can_answer():
    reader = source.PushingReader("x")
    kept = [source.EqualTo(("channel",), 1), source.EqualTo(("u", "v"), 1)]
    assert list(reader.pushFilters([source.EqualTo(("target",), "a"), source.In(("kind",), ("v2", "t3")), *kept, source.EqualTo(("kind",), "t3")])) == kept
    assert reader.wanted == {"target": {"a"}, "kind": {"t3"}}


def test_extras_lie_on_the_samples_of_their_exposure(spark, written):
    path, rows = written
    long = spark.read.format("oifits").load(path)
    for kind in ("amp", "phi"):
        found = source.aligned_extras(long, kind).collect()
        assert len(found) == 48 and all(r.sample_id for r in found) and len({r.sample_id for r in found}) == 48
    vis = {r.sample_id: r for r in source.sample_ids(long).collect()}
    want = keyed(rows.where("kind = 'phi'"))
    for r in source.aligned_extras(long, "phi").collect():
        v = vis[r.sample_id]
        w = want[(v.file.rsplit("/")[-1], "phi", v.target, v.row, v.channel)]
        assert r.value == pytest.approx(w.value * (-1 if w.sta1 == 2 else 1))


def test_days_and_times_must_both_agree(spark):
    kind = "file string, insname string, k int, mjd double, time double, {} long"
    left = spark.createDataFrame([("f", "i", 1, 1.0, 0.0, 1), ("f", "i", 1, 1.0, 500.0, 2), ("f", "i", 1, 2.0, 0.0, 3)], kind.format("left_id"))
    right = spark.createDataFrame([("f", "i", 1, 1.0, 500.0, 7), ("f", "i", 1, 1.00005, 0.0, 8), ("f", "i", 2, 2.0, 0.0, 9), ("f", "i", 1, 1.00005, 0.0, 6)], kind.format("sample_id"))
    tolerance = spark.createDataFrame([("f", "i", 1e-4)], "file string, insname string, tolerance double")
    found = source.same_exposure(left, right, ["k"], "sample_id", tolerance).collect()
    assert {r.left_id: r.sample_id for r in found} == {1: 6, 2: 7, 3: None}


def test_frames_take_the_mean_of_their_rows(spark, written):
    long = spark.read.format("oifits").load(written[0]).where("kind = 'v2'")
    near = long.withColumn("mjd", F.col("mjd") + F.col("channel") * 1e-5)
    rows = source.frame_means(near).collect()
    assert len(rows) == 48 and all(r.frame_mjd == pytest.approx(r.mjd - (r.channel - 1) * 1e-5) for r in rows)


def test_missing_files_and_empty_folders(spark, tmp_path):
    source.register(spark)
    assert spark.read.format("oifits").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("oifits").load(str(tmp_path / "none")).count()
