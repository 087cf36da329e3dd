"""The query catalogue: name -> callable, and name -> SQL for the same rows.

Each query applies a library operator to a whole table of the driver's schema, read as observations (see derived.py).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, orbits as kepler, photometry, special
from ..functions.cx import Cx
from ..operators import detection, imaging, joins, kernels, orbits, select, stats
from . import checks, derived, grid, models
from .derived import BASELINES, EPOCHS, PIXELS, RADIO, SAMPLES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MAS = geometry.MAS
K2 = f"{-2 * math.pi * MAS!r}::DOUBLE"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Grids ---------------------------------------------------------------------------------------------------------------

AXES = {"dra": [-10.0, -5.0, 0.0, 5.0, 10.0], "ddec": [-10.0, -5.0, 0.0, 5.0, 10.0], "flux": [0.01, 0.1]}
BINARY = models.BinaryCartesian(x="dra", y="ddec", ratio="flux")
GRID_SQL = f"""{SAMPLES}, pts AS (SELECT (row_number() OVER (ORDER BY x, y, f) - 1)::BIGINT AS point_id, x AS dra, y AS ddec, f AS flux
    FROM unnest([-10.0::DOUBLE, -5, 0, 5, 10]) a(x), unnest([-10.0::DOUBLE, -5, 0, 5, 10]) b(y), unnest([0.01::DOUBLE, 0.1]) c(f)),
    ph AS (SELECT pts.*, value, error, ((u / wavel) * dra + (v / wavel) * ddec) * {K2} AS p FROM samples, pts),
    mv AS (SELECT *, pow((1 + flux * cos(p)) / (1 + flux), 2) + pow(flux * sin(p) / (1 + flux), 2) AS m FROM ph),
    ll AS (SELECT point_id, dra, ddec, flux, -0.5::DOUBLE * sum(pow((m - value) / error, 2)) AS loglike FROM mv GROUP BY ALL)"""


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = grid.axes(spark, **AXES)
    return grid.likelihood_grid(derived.samples(spark, sf_dir), points, BINARY, n_points=50).join(F.broadcast(points), "point_id")


@query(f"WITH {GRID_SQL} SELECT dra, ddec, flux, round(loglike, 4) AS loglike FROM ll")
def binary_loglike_grid(spark, sf_dir):
    return rounded(_binary(spark, sf_dir), 4, "loglike").select("dra", "ddec", "flux", "loglike")


@query(f"WITH {GRID_SQL} SELECT dra, ddec, flux, round(loglike, 4) AS loglike FROM ll ORDER BY loglike DESC, point_id LIMIT 1")
def best_grid_point(spark, sf_dir):
    return rounded(grid.best_point(_binary(spark, sf_dir)), 4, "loglike").select("dra", "ddec", "flux", "loglike")


@query(f"WITH {GRID_SQL} SELECT dra, ddec, arg_max(flux, loglike) AS flux, round(max(loglike), 4) AS loglike FROM ll WHERE NOT (dra = 0 AND ddec = 0) GROUP BY ALL")
def optimized_flux_grid(spark, sf_dir):
    # at no offset the flux makes no difference
    return rounded(grid.best_per(_binary(spark, sf_dir).where("not (dra = 0 and ddec = 0)"), ["dra", "ddec"]), 4, "loglike").select("dra", "ddec", "flux", "loglike")


@query(f"""WITH {GRID_SQL}, r AS (SELECT loglike - (SELECT max(loglike) FROM ll) AS x, (CASE WHEN abs(dra) = 10 THEN 0.125 ELSE 0.25 END * CASE WHEN abs(ddec) = 10 THEN 0.125 ELSE 0.25 END * 0.5)::DOUBLE AS w,
    (SELECT max(loglike) FROM ll) - (SELECT loglike FROM ll WHERE dra = 0 AND ddec = 0 AND flux = 0.01) AS m FROM ll) SELECT round(max(m) + ln(sum(w * exp(x))), 4) AS log_bayes_factor FROM r""")
def log_bayes_factor(spark, sf_dir):
    ll = _binary(spark, sf_dir)
    null = ll.where("dra = 0 and ddec = 0 and flux = 0.01").select(F.col("loglike").alias("null_ll"))
    return rounded(grid.log_bayes_factor(ll.crossJoin(F.broadcast(null)), AXES, F.col("null_ll")), 4, "log_bayes_factor")


@query(f"""WITH {SAMPLES}, pts AS (SELECT x AS dra, y AS ddec FROM unnest([-10.0::DOUBLE, -5, 5, 10]) a(x), unnest([-10.0::DOUBLE, -5, 0, 5, 10]) b(y)),
    g AS (SELECT dra, ddec, 2 * (cos(((u / wavel) * dra + (v / wavel) * ddec) * {K2}) - 1) AS x, value - 1 AS r, error AS s FROM samples, pts),
    t AS (SELECT dra, ddec, sum(x * r / (s * s)) AS b, sum(x * x / (s * s)) AS c FROM g GROUP BY ALL)
    SELECT dra, ddec, round(b / c, 6) AS flux, round(1 / sqrt(c), 6) AS flux_error, round(b / sqrt(c), 4) AS snr FROM t""")
def linear_flux_map(spark, sf_dir):
    points = grid.axes(spark, dra=[-10.0, -5.0, 5.0, 10.0], ddec=AXES["ddec"])
    s = models.samples_uv()
    slope = (geometry.offset_phase(s.u, s.v, "dra", "ddec").re - 1.0) * 2.0
    out = grid.linear_flux(derived.samples(spark, sf_dir), points, slope, F.col("value") - 1.0)
    return rounded(rounded(out, 6, "flux", "flux_error"), 4, "snr").join(F.broadcast(points), "point_id").select("dra", "ddec", "flux", "flux_error", "snr")


def _disk_sql() -> str:
    def poly(x, c):
        out = f"{c[-1]!r}::DOUBLE"
        for k in c[-2::-1]:
            out = f"({out}) * {x} + ({k!r})::DOUBLE"
        return out

    small, big, phase = poly("y", special.J1_SMALL), poly("t", special.J1_MODULUS), poly("t", special.J1_PHASE)
    return f"""WITH {SAMPLES}, a AS (SELECT d AS diam, value, error, sqrt(pow(u / wavel, 2) + pow(v / wavel, 2)) * d * {math.pi * MAS!r}::DOUBLE AS x FROM samples, unnest([0.5::DOUBLE, 1, 2, 4, 8]) q(d)),
        b AS (SELECT *, pow(x / 3, 2) AS y, 3 / greatest(x, 3.0::DOUBLE) AS t FROM a),
        c AS (SELECT diam, value, error, 2 * CASE WHEN x <= 3 THEN {small} ELSE ({big}) * cos(x + {phase}) / (sqrt(x) * x) END AS m FROM b)
        SELECT diam, round(-0.5::DOUBLE * sum(pow((m * m - value) / error, 2)), 3) AS loglike FROM c GROUP BY 1"""


@query(_disk_sql())
def uniform_disk_grid(spark, sf_dir):
    points = grid.axes(spark, diam=[0.5, 1.0, 2.0, 4.0, 8.0])
    out = grid.likelihood_grid(derived.samples(spark, sf_dir), points, models.UniformDisk(diam="diam"), n_points=5)
    return rounded(out, 3, "loglike").join(F.broadcast(points), "point_id").select("diam", "loglike")


@query(f"""WITH {SAMPLES}, a AS (SELECT s AS sigma, value, error, (pow(u / wavel, 2) + pow(v / wavel, 2)) * pow(s * {MAS!r}::DOUBLE, 2) * {-2 * math.pi**2!r}::DOUBLE AS e FROM samples, unnest([0.2::DOUBLE, 0.5, 1, 3]) q(s)),
    p AS (SELECT *, pow(0.7::DOUBLE * exp(e) + 0.3::DOUBLE, 2) AS m FROM a) SELECT sigma, round(-0.5::DOUBLE * sum(pow((m - value) / error, 2) + ln(2 * pi() * error * error)), 3) AS loglike FROM p GROUP BY 1""")
def star_and_gaussian_grid(spark, sf_dir):
    points = grid.axes(spark, sigma=[0.2, 0.5, 1.0, 3.0])
    model = models.System(parts=(models.PointSource(flux=0.3), models.GaussianDisk(sigma="sigma", flux=0.7)))
    out = grid.likelihood_grid(derived.samples(spark, sf_dir), points, model, normalised=True, n_points=4)
    return rounded(out, 3, "loglike").join(F.broadcast(points), "point_id").select("sigma", "loglike")


@query(f"""WITH {SAMPLES}, q AS (SELECT dra, ddec, 2 * (cos(((u / wavel) * dra + (v / wavel) * ddec) * {K2}) - 1) AS x, value - 1 AS r, error AS s, user_id % 20 AS draw FROM samples,
    (SELECT x AS dra, y AS ddec FROM unnest([-10.0::DOUBLE, -5, 5, 10]) a(x), unnest([-10.0::DOUBLE, -5, 0, 5, 10]) b(y))),
    t AS (SELECT draw, dra, ddec, sum(x * r / (s * s)) AS b, sum(x * x / (s * s)) AS c FROM q GROUP BY ALL)
    SELECT draw, round(max(CASE WHEN b > 0 THEN b * b / c ELSE 0 END), 3) AS delta_chi2, round(max(b / sqrt(c)), 4) AS max_snr FROM t GROUP BY 1""")
def detection_statistics(spark, sf_dir):
    points = grid.axes(spark, dra=[-10.0, -5.0, 5.0, 10.0], ddec=AXES["ddec"])
    s = models.samples_uv()
    slope = (geometry.offset_phase(s.u, s.v, "dra", "ddec").re - 1.0) * 2.0
    rows = derived.samples(spark, sf_dir).withColumn("draw", F.col("user_id") % 20)
    s2 = F.col("error") * F.col("error")
    sums = grid.evaluate(rows, points, {"b": slope * (F.col("value") - 1.0) / s2, "c": slope * slope / s2}, ("draw", "point_id"), 20)
    return rounded(rounded(detection.max_statistics(sums, ["draw"]), 3, "delta_chi2"), 4, "max_snr")


#: Noise that both engines can draw: a sum of three uniform numbers, of unit variance, from the fractions of sines.
_SINE = ("12.9898", "78.233", "37.719", "43758.5453")


def noise_sql(k: str, i: str) -> str:
    a, b, c, d = (f"{x}::DOUBLE" for x in _SINE)
    return "2.0 * (" + " + ".join(f"(abs(sin({i} * {a} + {k} * {b} + {j} * {c}) * {d}) % 1)" for j in range(3)) + " - 1.5::DOUBLE)"


def noise_of(k, id: str = "sample_id"):
    a, b, c, d = map(float, _SINE)
    part = lambda j: F.abs(F.sin(F.col(id) * a + k * b + j * c) * d) % 1
    return (part(0) + part(1) + part(2) - 1.5) * 2.0


@query(f"""WITH {SAMPLES}, d AS (SELECT sample_id, u / wavel AS p, v / wavel AS q, error, -1 AS draw, value FROM samples UNION ALL
        SELECT sample_id, u / wavel, v / wavel, error, k, 1 + error * {noise_sql('k', 'sample_id')} FROM samples, range(20) r(k)),
    g AS (SELECT draw, x, y, 2 * (cos((p * x + q * y) * {K2}) - 1) AS s, value - 1 AS r, error AS e FROM d, unnest([-5.0::DOUBLE, 5]) a(x), unnest([-5.0::DOUBLE, 5]) b(y)),
    t AS (SELECT draw, x, y, sum(s * r / (e * e)) AS b, sum(s * s / (e * e)) AS c FROM g GROUP BY ALL)
    SELECT draw::INT AS draw, round(max(CASE WHEN b > 0 THEN b * b / c ELSE 0 END), 4) AS delta_chi2, round(max(b / sqrt(c)), 5) AS max_snr FROM t GROUP BY 1""")
def injection_false_alarm(spark, sf_dir):
    """Twenty nulls and the observation, searched at four offsets: the statistics that false alarms are counted from."""
    s = models.samples_uv()
    points = grid.axes(spark, dra=[-5.0, 5.0], ddec=[-5.0, 5.0])
    slope = (geometry.offset_phase(s.u, s.v, "dra", "ddec").re - 1.0) * 2.0
    rows = derived.samples(spark, sf_dir)
    drawn = rows.withColumn("draw", F.lit(-1)).unionByName(detection.gaussian_null(rows, F.lit(1.0), 20, noise=noise_of))
    s2 = F.col("error") * F.col("error")
    sums = grid.evaluate(drawn, points, {"b": slope * (F.col("value") - 1.0) / s2, "c": slope * slope / s2}, ("draw", "point_id"), 4)
    return rounded(rounded(detection.max_statistics(sums, ["draw"]), 4, "delta_chi2"), 5, "max_snr")


def log_gamma_tail(a: str, x: str, terms: int = 4000) -> str:
    """SQL of ln Q(a, x), the upper incomplete gamma function, for x of a or more: a continued fraction, from its end."""
    fraction = f"list_reduce([({x}) + {2 * terms + 1} - ({a})] || range({terms}, 0, -1)::DOUBLE[], lambda t, k: ({x}) + 2 * k - 1 - ({a}) + k * (({a}) - k) / t)"
    return f"(-({x}) + ({a}) * ln({x}) - lgamma({a}) - ln({fraction}))"


@query(f"""WITH RECURSIVE {GRID_SQL}, n AS (SELECT count(*) / 2.0::DOUBLE AS h FROM samples), top AS (SELECT max(loglike) AS best FROM ll),
    tail AS (SELECT dra, ddec, flux, greatest({log_gamma_tail('h', 'h * loglike / best')}, ln(2e-300::DOUBLE)) AS q FROM ll, n, top),
    z AS (SELECT 0 AS i, *, 0.0::DOUBLE AS lo, 40.0::DOUBLE AS hi FROM tail UNION ALL SELECT i + 1, dra, ddec, flux, q, CASE WHEN more THEN m ELSE lo END, CASE WHEN more THEN hi ELSE m END FROM
        (SELECT *, (lo + hi) / 2 AS m, {log_gamma_tail('0.5::DOUBLE', 'pow((lo + hi) / 2, 2) / 2', 600)} > q AS more FROM z WHERE i < 45))
    SELECT dra, ddec, flux, round((lo + hi) / 2, 4) AS nsigma FROM z WHERE i = 45""")
def companion_limits(spark, sf_dir):
    """Significance of each grid point's chi-square against the best one's, by the incomplete gamma function."""
    ll = _binary(spark, sf_dir)
    n = derived.samples(spark, sf_dir).count()
    best = ll.agg(F.max("loglike").alias("best"))
    chi2r = lambda c: F.col(c) * (-2.0 / n)
    return ll.crossJoin(F.broadcast(best)).select("dra", "ddec", "flux", special.nsigma(chi2r("loglike"), chi2r("best"), F.lit(float(n))).alias("nsigma")).withColumn("nsigma", F.round("nsigma", 4))


# Selection and errors ------------------------------------------------------------------------------------------------


@query(f"WITH {SAMPLES} SELECT sample_id, wavel FROM samples WHERE wavel BETWEEN 2.95e-6 AND 3.15e-6 OR wavel BETWEEN 3.35e-6 AND 3.5e-6")
def wavelength_windows(spark, sf_dir):
    return select.select(derived.samples(spark, sf_dir), ranges=[(2.95e-6, 3.15e-6), (3.35e-6, 3.5e-6)]).select("sample_id", "wavel")


@query(f"WITH {SAMPLES} SELECT channel, count(*)::BIGINT AS n FROM samples WHERE wavel >= 3.05e-6 AND NOT wavel BETWEEN 3.15e-6 AND 3.25e-6 GROUP BY 1")
def exclude_windows(spark, sf_dir):
    return select.select(derived.samples(spark, sf_dir), wavel_min=3.05e-6, exclude=[(3.15e-6, 3.25e-6)]).groupBy("channel").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS value, greatest(l_quantity, 20.0::DOUBLE, abs(l_extendedprice) * 0.001::DOUBLE) AS error FROM lineitem")
def error_floor(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("error"))
    return select.with_error_floor(rows, absolute=20.0, relative=0.001)


@query("""SELECT l_returnflag, round(sum(sqrt(pow(1.5::DOUBLE * l_quantity, 2) + 4.0::DOUBLE + pow(l_extendedprice * 0.001::DOUBLE, 2))), 3) AS error FROM lineitem GROUP BY 1""")
def error_inflation(spark, sf_dir):
    e = photometry.inflate(F.col("l_quantity"), F.col("l_extendedprice"), scale=1.5, absolute=2.0, relative=0.001)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(e), 3).alias("error"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE NOT (l_returnflag = 'R' OR l_discount <= 0)) OR o_orderkey IN (SELECT l_partkey FROM lineitem WHERE l_tax > 0)")
def unflagged(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    vis = li.select(F.col("l_orderkey").alias("sample_id"), F.col("l_quantity").alias("value"), F.col("l_discount").alias("error"), (F.col("l_returnflag") == "R").alias("flag"))
    tri = li.select(*(F.col("l_partkey").alias(s) for s in ("s1", "s2", "s3")), F.col("l_quantity").alias("phi"), F.col("l_tax").alias("d_phi"), F.lit(False).alias("flag"))
    return select.unflagged(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id")), vis, tri).withColumnRenamed("sample_id", "o_orderkey")


@query(f"""WITH {SAMPLES}, a AS (SELECT channel, sqrt(value) AS amp, error / (2 * sqrt(value)) AS e, ln(sqrt(value)) AS la, error / (2 * value) AS le FROM samples WHERE value > 0)
    SELECT channel, count(*)::BIGINT AS n, round(sum(amp), 4) AS amp, round(sum(e), 4) AS amp_error, round(sum(la), 4) AS logamp, round(sum(le), 4) AS logamp_error FROM a GROUP BY 1""")
def observed_transforms(spark, sf_dir):
    amp, logamp = (photometry.transform_observed(F.col("value"), F.col("error"), k) for k in ("amp", "logamp"))
    rows = derived.samples(spark, sf_dir).select("channel", amp[0].alias("a"), amp[1].alias("b"), logamp[0].alias("c"), logamp[1].alias("d"))
    return rows.groupBy("channel").agg(F.count("a").alias("n"), *(F.round(F.sum(x), 4).alias(n) for x, n in zip("abcd", ("amp", "amp_error", "logamp", "logamp_error"))))


@query("""SELECT s_suppkey, round(x - floor(x / (2 * pi())) * 2 * pi() - pi(), 6) AS wrapped, round(pa - floor(pa / 360) * 360, 6) AS pa, round(sqrt(a * a + b * b), 6) AS sep, round(a * cos(0.5) + b * sin(0.5), 6) AS rx,
    round(2.5 * log10(1 / greatest(f, 1e-30)), 6) AS dmag, round(f, 6) AS flux FROM (SELECT s_suppkey, s_acctbal / 100 + pi() AS x, degrees(atan2(s_acctbal, s_suppkey)) AS pa, s_acctbal AS a, s_suppkey::DOUBLE AS b,
    (s_suppkey + 1)::DOUBLE / 1000 AS f FROM supplier)""")
def scalar_geometry(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a, b, f = F.col("s_acctbal"), F.col("s_suppkey").cast("double"), (F.col("s_suppkey") + 1).cast("double") / 1000
    out = s.select("s_suppkey", geometry.wrap_phase(a / 100).alias("wrapped"), geometry.position_angle(a, b).alias("pa"), geometry.separation_pa(a, b)["sep"].alias("sep"), geometry.rotate(a, b, math.degrees(0.5))[0].alias("rx"), photometry.flux_to_delta_mag(f).alias("dmag"), photometry.delta_mag_to_flux(photometry.flux_to_delta_mag(f)).alias("flux"))
    return rounded(out, 6, *out.columns[1:])


# Joins and windows ---------------------------------------------------------------------------------------------------


@query(f"""WITH {BASELINES} SELECT p.frame, p.station_a AS a, p.station_b AS b, q.station_b AS c, p.sample_id AS s1, q.sample_id AS s2, r.sample_id AS s3 FROM baselines p JOIN baselines q ON p.frame = q.frame AND p.station_b = q.station_a
    JOIN baselines r ON r.frame = p.frame AND r.station_a = p.station_a AND r.station_b = q.station_b""")
def closure_triangles(spark, sf_dir):
    b = derived.baselines(spark, sf_dir)
    seen = b.select("frame", F.explode(F.array("station_a", "station_b")).alias("station")).distinct()
    return joins.closure_triangles(b, joins.all_triangles(seen, ["frame"])).select("frame", "a", "b", "c", "s1", "s2", "s3")


@query(f"""WITH {BASELINES}, t AS (SELECT p.frame, p.station_a AS a, p.station_b AS b, q.station_b AS c, p.phi + q.phi - r.phi + pi() AS x FROM baselines p JOIN baselines q ON p.frame = q.frame AND p.station_b = q.station_a
    JOIN baselines r ON r.frame = p.frame AND r.station_a = p.station_a AND r.station_b = q.station_b) SELECT frame, a, b, c, round(x - floor(x / (2 * pi())) * (2 * pi()) - pi(), 6) AS closure FROM t""")
def closure_phase_sum(spark, sf_dir):
    b = derived.baselines(spark, sf_dir)
    seen = b.select("frame", F.explode(F.array("station_a", "station_b")).alias("station")).distinct()
    tri = joins.closure_triangles(b, joins.all_triangles(seen, ["frame"])).withColumn("tri_id", F.struct("frame", "a", "b", "c"))
    return rounded(joins.closure_phases(tri, b.select("sample_id", "phi")), 6, "closure").select("tri_id.*", "closure")


#: Triangles of four stations close on each other along (1, -1, 1, -1) / 2, and R is 4/3 across it; two that share a
#: baseline correlate by a third.
_SINES = "sin(closure) / 0.1::DOUBLE"


@query(f"""WITH {BASELINES}, t AS (SELECT x.frame, CASE WHEN (x.station_b = 1 AND y.station_b = 2) OR (x.station_a = 0 AND x.station_b = 2) THEN 1 ELSE -1 END AS side, x.phi + y.phi - z.phi AS closure FROM baselines x
    JOIN baselines y ON y.frame = x.frame AND y.station_a = x.station_b JOIN baselines z ON z.frame = x.frame AND z.station_a = x.station_a AND z.station_b = y.station_b),
    s AS (SELECT frame, count(*) AS m, sum(pow({_SINES}, 2)) AS yy, sum(side * {_SINES}) AS along, sum({_SINES}) AS y, sum(pow(2 * pow(sin(closure / 2), 2) / 0.1::DOUBLE, 2)) AS penalty FROM t GROUP BY 1)
    SELECT frame, round(CASE m WHEN 1 THEN yy WHEN 2 THEN 9.0::DOUBLE / 8 * (yy * 4 / 3 - y * y / 3) ELSE 0.75::DOUBLE * (yy - along * along / 4) END, 5) AS chi2, round(penalty, 5) AS penalty,
    round(CASE m WHEN 1 THEN 0 WHEN 2 THEN ln(8.0::DOUBLE / 9) / 2 ELSE 1.5::DOUBLE * ln(4.0::DOUBLE / 3) END + least(m, 3) * ln(0.1::DOUBLE), 6) AS log_norm, least(m, 3)::BIGINT AS rank FROM s""")
def closure_chi2(spark, sf_dir):
    """Whitened chi-square of correlated closure residuals by frame, in a dense kernel a group."""
    b = derived.baselines(spark, sf_dir)
    seen = b.select("frame", F.explode(F.array("station_a", "station_b")).alias("station")).distinct()
    tri = joins.closure_triangles(b, joins.all_triangles(seen, ["frame"])).withColumn("tri_id", F.xxhash64("frame", "a", "b", "c"))
    phases = joins.closure_phases(tri, b.select("sample_id", "phi"))
    out = kernels.closure_chi2(tri.join(phases, "tri_id").select("frame", F.col("closure").alias("residual"), F.lit(0.1).alias("sigma"), "s1", "s2", "s3"))
    return rounded(rounded(out, 5, "chi2", "penalty"), 6, "log_norm")


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts)::DOUBLE / 86400000000.0::DOUBLE AS t FROM events), l AS (SELECT * FROM e WHERE event_type = 'error'), r AS (SELECT * FROM e WHERE event_type <> 'error'),
    j AS (SELECT l.event_id AS left_id, r.event_id AS right_id, abs(l.t - r.t) AS d, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t - r.t), r.event_id) AS k FROM l JOIN r ON l.user_id = r.user_id AND abs(l.t - r.t) <= 0.02)
    SELECT l.event_id AS left_id, right_id, round(d, 8) AS distance FROM l LEFT JOIN j ON l.event_id = left_id AND k = 1""")
def nearest_frame_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 86400000000.0).alias("t"))
    left = e.where("event_type = 'error'").select(F.col("event_id").alias("left_id"), "user_id", F.col("t").alias("lt"))
    right = e.where("event_type <> 'error'").select(F.col("event_id").alias("right_id"), "user_id", F.col("t").alias("rt"))
    return rounded(joins.nearest(left, right, ["user_id"], "lt", "rt", 0.02, "right_id"), 8, "distance").select("left_id", "right_id", "distance")


@query(f"WITH {SAMPLES} SELECT a.user_id, count(*)::BIGINT AS pairs FROM samples a JOIN samples b ON a.user_id = b.user_id AND a.sample_id < b.sample_id AND abs(a.mjd - b.mjd) <= 0.01 GROUP BY 1")
def pairwise_range_frames(spark, sf_dir):
    return joins.range_pairs(derived.samples(spark, sf_dir), ["user_id"], "mjd", 0.01, "sample_id").groupBy("user_id").agg(F.count("*").alias("pairs"))


EPOCH_SQL = f"""{SAMPLES}, g AS (SELECT *, CASE WHEN mjd - lag(mjd) OVER w > 0.05 THEN 1 ELSE 0 END AS new FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY mjd)),
    e AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY mjd)::BIGINT AS epoch FROM g)"""


@query(f"WITH {EPOCH_SQL} SELECT sample_id, user_id, epoch FROM e")
def session_epochs(spark, sf_dir):
    return joins.epochs(derived.samples(spark, sf_dir), ["user_id"], "mjd", gap_days=0.05).select("sample_id", "user_id", "epoch")


@query(f"WITH {EPOCH_SQL} SELECT user_id, epoch, count(*)::BIGINT AS n, round(avg(mjd), 8) AS mjd, round(max(mjd) - min(mjd), 8) AS span FROM e GROUP BY 1, 2")
def epoch_summary(spark, sf_dir):
    out = joins.epochs(derived.samples(spark, sf_dir), ["user_id"], "mjd", gap_days=0.05)
    return out.groupBy("user_id", "epoch").agg(F.count("*").alias("n"), F.round(F.avg("mjd"), 8).alias("mjd"), F.round(F.max("mjd") - F.min("mjd"), 8).alias("span"))


@query(f"""WITH {RADIO}, r AS (SELECT sqrt(u * u + v * v) AS q, CASE WHEN v < 0 OR (v = 0 AND u < 0) THEN -1 ELSE 1 END AS s, * FROM radio), lim AS (SELECT min(q) FILTER (q > 0) AS lo, max(q) * (1 + 1e-12::DOUBLE) AS hi FROM r),
    c AS (SELECT point_id, least(greatest(CASE WHEN q <= lo THEN 0 ELSE floor(ln(q / lo) / ln(hi / lo) * 6) END, 0), 5)::INT * 8 + least(greatest(floor(atan2(v * s, u * s) / pi() * 8), 0), 7)::INT AS cell FROM r, lim),
    f AS (SELECT cell, ((row_number() OVER (ORDER BY md5('0/' || cell::VARCHAR)) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT cell FROM c)) SELECT point_id, fold FROM c JOIN f USING (cell)""")
def dartboard_folds(spark, sf_dir):
    return joins.dartboard_folds(derived.radio(spark, sf_dir), 5, 6, 8).select("point_id", "fold")


@query(f"""WITH {SAMPLES}, d AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, wavel ORDER BY sample_id) AS first FROM samples), o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY wavel, sample_id) - 1 AS k,
    count(*) OVER (PARTITION BY user_id, event_type) AS length FROM d WHERE first = 1) SELECT sample_id, k::INT AS k, length::BIGINT AS length FROM o WHERE length >= 2""")
def channel_chains(spark, sf_dir):
    return stats.channel_chains(derived.samples(spark, sf_dir), ["user_id", "event_type"], "wavel", "sample_id").select("sample_id", F.col("k").cast("int"), "length")


@query(f"""WITH {SAMPLES}, s AS (SELECT sample_id, user_id, mjd, value * 40 AS p, lag(value * 40) OVER (PARTITION BY user_id ORDER BY mjd) AS q FROM samples),
    w AS (SELECT *, coalesce((p - q + pi()) - floor((p - q + pi()) / (2 * pi())) * (2 * pi()) - pi(), p) AS step FROM s) SELECT sample_id, round(sum(step) OVER (PARTITION BY user_id ORDER BY mjd ROWS UNBOUNDED PRECEDING), 6) AS unwrapped FROM w""")
def phase_unwrap(spark, sf_dir):
    rows = derived.samples(spark, sf_dir).withColumn("phase", F.col("value") * 40)
    return rounded(stats.phase_unwrap(rows, ["user_id"], "mjd", "phase"), 6, "unwrapped").select("sample_id", "unwrapped")


@query(f"""WITH {SAMPLES}, c AS (SELECT user_id, regr_slope(value, 1 / wavel) AS b, avg(value) AS my, avg(1 / wavel) AS mx FROM samples WHERE channel <> 2 GROUP BY 1)
    SELECT sample_id, round(value / (my + coalesce(b, 0) * (1 / wavel - mx)), 5) AS normalised FROM samples LEFT JOIN c USING (user_id)""")
def continuum_normalise(spark, sf_dir):
    out = stats.continuum_normalise(derived.samples(spark, sf_dir), ["user_id"], "value", "wavel", F.col("channel") != 2)
    return rounded(out, 5, "normalised").select("sample_id", "normalised")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (row_number() OVER (ORDER BY floor(l_extendedprice / 1000 + 0.5) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice))::INT AS rank FROM lineitem")
def rank_scores(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("index", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return grid.rank_scores(li, "l_extendedprice", "index", 1000.0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("rank").cast("int").alias("rank"))


@query("""SELECT l_suppkey, l_extendedprice, l_orderkey, k FROM (SELECT *, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey))::INT AS k FROM lineitem) WHERE k <= 3""")
def top_k_per_band(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w)).where("k <= 3").select("l_suppkey", "l_extendedprice", "l_orderkey", "k")


@query("SELECT 0 AS run, event_id, value FROM events WHERE event_type = 'error' UNION ALL SELECT 1, event_id, value FROM events WHERE event_type <> 'error'")
def union_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return select.union_runs(e.where("event_type = 'error'"), e.where("event_type <> 'error'")).select("run", "event_id", "value")


@query("SELECT (l_linenumber)::INT AS channel FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = (SELECT count(DISTINCT l_suppkey) FROM lineitem)")
def common_channels(spark, sf_dir):
    return select.common_channels(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber").withColumnRenamed("l_linenumber", "channel")


# Statistics ----------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT CASE WHEN l_quantity = 50 THEN 9 ELSE floor(l_quantity / 50 * 10) END::INT AS bin, l_extendedprice AS x FROM lineitem WHERE l_quantity BETWEEN 0 AND 50)
    SELECT r.range::INT AS bin, ((r.range + 0.5) * 5)::DOUBLE AS radius, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(median(x), 4) AS median, round(quantile_cont(x, 0.16), 4) AS q16, round(quantile_cont(x, 0.84), 4) AS q84,
    count(x)::BIGINT AS n FROM range(10) r LEFT JOIN b ON b.bin = r.range GROUP BY 1, 2""")
def radial_profile(spark, sf_dir):
    return rounded(stats.radial_profile(table(spark, sf_dir, "lineitem"), "l_extendedprice", F.col("l_quantity"), 50.0, 10), 4, "mean", "std", "median", "q16", "q84")


@query("SELECT l_returnflag, l_linestatus, round(sum(pow((l_extendedprice - 30000) / (l_quantity * 100), 2)), 4) AS chi2, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def chi2_by_group(spark, sf_dir):
    r = (F.col("l_extendedprice") - 30000.0) / (F.col("l_quantity") * 100.0)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(r * r), 4).alias("chi2"), F.count("*").alias("n"))


@query(f"""WITH {RADIO}, o AS (SELECT ddid, obs, row_number() OVER w AS rn, (pow(re - lead(re) OVER w, 2) + pow(im - lead(im) OVER w, 2)) / (1 / weight + 1 / lead(weight) OVER w) / 2 AS z FROM radio
    WINDOW w AS (PARTITION BY scan, ant1, ant2, freq, ddid ORDER BY time, point_id)) SELECT ddid, obs, round(sqrt(avg(z)), 6) AS scale, round(sqrt(greatest(avg(z * z) - avg(z) * avg(z), 0) / count(*)) / (2 * sqrt(avg(z))), 6) AS se,
    count(*)::BIGINT AS pairs FROM o WHERE rn % 2 = 1 AND z IS NOT NULL GROUP BY GROUPING SETS ((ddid), (obs), ())""")
def sigma_scale_pairs(spark, sf_dir):
    return rounded(stats.sigma_scale(derived.radio(spark, sf_dir)), 6, "scale", "se")


CV_SQL = """r AS (SELECT l_linenumber AS setting, l_orderkey % 5 AS fold, avg(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2),
    c AS (SELECT setting, avg(score) AS mean, stddev_samp(score) AS sd, stddev_samp(score) / sqrt(count(*)) AS se FROM r GROUP BY 1), b AS (SELECT * FROM c ORDER BY mean, setting LIMIT 1)"""


@query(f"""WITH {CV_SQL} SELECT setting, round(mean, 4) AS mean, round(sd, 4) AS sd, round(se, 4) AS se, true AS complete, setting = (SELECT setting FROM b) AS best,
    setting = (SELECT max(c.setting) FROM c, b WHERE c.mean <= b.mean + b.se) AS one_se, (SELECT setting FROM b) IN (SELECT unnest([min(setting), max(setting)]) FROM c) AS edge FROM c""")
def cv_curve(spark, sf_dir):
    rec = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("setting"), (F.col("l_orderkey") % 5).alias("fold")).agg(F.avg("l_extendedprice").alias("score"))
    return rounded(stats.cv_curve(rec), 4, "mean", "sd", "se")


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, median(abs(l_extendedprice - m)) OVER (PARTITION BY l_partkey) * 1.4826::DOUBLE AS mad FROM (SELECT *, median(l_extendedprice) OVER (PARTITION BY l_partkey) AS m FROM lineitem)) WHERE mad <= 0 OR l_extendedprice <= m + mad * 2")
def mad_outlier_cut(spark, sf_dir):
    return stats.mad_cut(table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_partkey"], "l_extendedprice", 2.0)


@query("""SELECT l_suppkey, min(v) AS quantile FROM (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS run, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS total FROM lineitem)
    WHERE run >= total * 0.5 GROUP BY 1""")
def weighted_median(spark, sf_dir):
    return stats.weighted_quantile(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity")


@query(f"""WITH {PIXELS}, w AS (SELECT image, truth / value AS v, sum(value) OVER (PARTITION BY image ORDER BY truth / value) AS run, sum(value) OVER (PARTITION BY image) AS total FROM px), a AS (SELECT image, min(v) AS a FROM w WHERE run >= total * 0.5 GROUP BY 1)
    SELECT image, round(1 - sum(abs(a * value - truth)) / sum(truth), 6) AS l1_score FROM px JOIN a USING (image) GROUP BY 1""")
def l1_score(spark, sf_dir):
    return rounded(stats.l1_score(derived.pixel_image(spark, sf_dir), ["image"], "value", "truth"), 6, "l1_score")


@query(f"""WITH {PIXELS}, q AS (SELECT image, value / sum(value) OVER w AS e, truth / sum(truth) OVER w AS r FROM px WINDOW w AS (PARTITION BY image)) SELECT image, round(corr(e, r), 6) AS ncc, round(sqrt(avg(pow(e - r, 2))), 8) AS rms,
    round(sqrt(sum(r * pow(e - r, 2)) / sum(r)) / max(r), 6) AS lawson FROM q GROUP BY 1""")
def image_metrics(spark, sf_dir):
    return rounded(rounded(stats.image_metrics(derived.pixel_image(spark, sf_dir), ["image"], "value", "truth"), 6, "ncc", "lawson"), 8, "rms")


@query(f"""WITH {SAMPLES}, c AS (SELECT event_type AS block, user_id AS chain, sum((value - 0.8) / error) AS s, sum(pow((value - 0.8) / error, 2)) AS q FROM samples GROUP BY 1, 2)
    SELECT block, round(greatest(1, sum(s * s) / sum(q)), 6) AS f, count(*)::BIGINT AS chains, false AS pooled FROM c GROUP BY 1""")
def tempering_factor(spark, sf_dir):
    rows = derived.samples(spark, sf_dir).select(F.col("event_type").alias("block"), F.col("user_id").alias("chain"), ((F.col("value") - 0.8) / F.col("error")).alias("z"))
    return rounded(stats.tempering_factors(rows), 6, "f")


@query("""WITH n AS (SELECT c_nationkey, -0.5::DOUBLE * sum(pow((c_acctbal - 4500) / 3000, 2)) / 100 AS a, -0.5::DOUBLE * sum(pow((c_acctbal - 4500) / 9000, 2)) / 100 - 0.5::DOUBLE AS b FROM customer GROUP BY 1),
    j AS (SELECT 0.5::DOUBLE * (1 - cos((2 * range - 1) * pi() / 52)) AS eps FROM range(1, 27)), t AS (SELECT eps, sum(ln((1 - eps) * exp(a) + eps * exp(b))) AS t FROM n, j GROUP BY 1) SELECT round(max(m) + ln(avg(exp(t - m))), 6) AS log_mixture FROM t, (SELECT max(t) AS m FROM t)""")
def outlier_mixture(spark, sf_dir):
    z = lambda s: F.sum(F.pow((F.col("c_acctbal") - 4500.0) / s, 2.0)) * -0.5 / 100
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(z(3000.0).alias("ll"), (z(9000.0) - 0.5).alias("ll_out")).withColumn("all", F.lit(1))
    return rounded(stats.outlier_mixture(n, ["all"], 25), 6, "log_mixture").select("log_mixture")


@query("""WITH m AS (SELECT l_suppkey, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1), d AS (SELECT l_suppkey, l_extendedprice - m AS x FROM lineitem JOIN m USING (l_suppkey))
    SELECT l_suppkey, round(avg(pow(x, 3)) / pow(avg(x * x), 1.5), 5) AS skewness, round(avg(pow(x, 4)) / pow(avg(x * x), 2) - 3, 5) AS kurtosis FROM d GROUP BY 1""")
def moments_skew_kurt(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.skewness("l_extendedprice"), 5).alias("skewness"), F.round(F.kurtosis("l_extendedprice"), 5).alias("kurtosis"))


@query("""WITH a AS (SELECT l_suppkey, radians(l_quantity * 9 - floor(l_quantity * 9 / 360) * 360) AS t FROM lineitem), m AS (SELECT l_suppkey, atan2(avg(sin(t)), avg(cos(t))) AS m FROM a GROUP BY 1),
    d AS (SELECT l_suppkey, m, t - m + pi() - floor((t - m + pi()) / (2 * pi())) * 2 * pi() - pi() AS d FROM a JOIN m USING (l_suppkey)), q AS (SELECT l_suppkey, degrees(max(m) + quantile_cont(d, 0.5)) AS x, degrees(max(m) + quantile_cont(d, 0.16)) AS y FROM d GROUP BY 1)
    SELECT l_suppkey, round(y - floor(y / 360) * 360, 5) AS q16, round(x - floor(x / 360) * 360, 5) AS q50 FROM q""")
def circular_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("angle", geometry.floor_mod(F.col("l_quantity") * 9, 360.0))
    return rounded(stats.circular_quantiles(rows, ["l_suppkey"], "angle", (0.16, 0.5)), 5, "q16", "q50")


@query("SELECT l_suppkey, round(max(m) + ln(avg(exp(l_quantity - m))), 6) AS logsumexp FROM (SELECT l_suppkey, l_quantity, max(l_quantity) OVER (PARTITION BY l_suppkey) AS m FROM lineitem) GROUP BY 1")
def logmeanexp(spark, sf_dir):
    return rounded(stats.logsumexp(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", mean=True), 6, "logsumexp")


# Detection -----------------------------------------------------------------------------------------------------------

SCORED = "s AS (SELECT n_chars::DOUBLE AS score, quality, doc_id FROM documents JOIN labels USING (doc_id))"


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(table(spark, sf_dir, "labels"), "doc_id")


@query(f"WITH {SCORED} SELECT (count(*) FILTER (score >= 3000))::BIGINT AS k, count(*)::BIGINT AS n, (count(*) FILTER (score >= 3000) + 1)::DOUBLE / (count(*) + 1) AS fap FROM s WHERE quality = 0")
def false_alarm_probability(spark, sf_dir):
    return detection.false_alarm_probability(_scored(spark, sf_dir).where("quality = 0"), "score", 3000.0).select("k", "n", "fap")


@query(f"WITH {SCORED} SELECT quality, round(quantile_cont(score, 0.95), 6) AS threshold, count(*)::BIGINT AS n FROM s GROUP BY 1")
def detection_threshold(spark, sf_dir):
    return rounded(detection.threshold(_scored(spark, sf_dir), "score", 0.05, ["quality"]), 6, "threshold")


ROC_SQL = f"""{SCORED}, g AS (SELECT score AS threshold, sum((quality = 1)::INT) AS p, sum((quality <> 1)::INT) AS q FROM s GROUP BY 1),
    roc AS (SELECT threshold, sum(q) OVER w / sum(q) OVER () AS fpr, sum(p) OVER w / sum(p) OVER () AS tpr FROM g WINDOW w AS (ORDER BY threshold DESC) UNION ALL SELECT 'infinity'::DOUBLE, 0.0, 0.0)"""


@query(f"WITH {ROC_SQL} SELECT threshold, round(fpr::DOUBLE, 8) AS fpr, round(tpr::DOUBLE, 8) AS tpr FROM roc")
def roc_curve(spark, sf_dir):
    return rounded(detection.roc(_scored(spark, sf_dir), "score", F.col("quality") == 1), 8, "fpr", "tpr")


@query(f"WITH {ROC_SQL} SELECT round(sum(a)::DOUBLE, 8) AS auc FROM (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM roc WINDOW w AS (ORDER BY threshold DESC))")
def roc_auc(spark, sf_dir):
    return rounded(detection.auc(detection.roc(_scored(spark, sf_dir), "score", F.col("quality") == 1)), 8, "auc")


SEPS, FLUXES = [1.0, 11.0, 21.0, 31.0, 41.0, 51.0], [0.0, 0.021, 0.041, 0.061, 0.081, 0.11]
COMPLETE_SQL = """c AS (SELECT floor((l_quantity - 1) / 10)::INT AS sep_bin, CASE WHEN l_discount < 0.021 THEN 0 WHEN l_discount < 0.041 THEN 1 WHEN l_discount < 0.061 THEN 2 WHEN l_discount < 0.081 THEN 3 ELSE 4 END AS flux_bin,
    avg((l_extendedprice * (1 + 10 * l_discount) > 40000)::INT) AS completeness, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2)"""


def _complete(spark, sf_dir):
    hit = F.col("l_extendedprice") * (F.col("l_discount") * 10 + 1) > 40000
    return detection.completeness(table(spark, sf_dir, "lineitem"), hit, F.col("l_quantity"), F.col("l_discount"), SEPS, FLUXES)


@query(f"WITH {COMPLETE_SQL} SELECT sep_bin, flux_bin, round(completeness, 8) AS completeness, n FROM c")
def completeness_map(spark, sf_dir):
    return rounded(_complete(spark, sf_dir), 8, "completeness")


CONTRAST_EDGES = [0.001, 0.021, 0.041, 0.061, 0.081, 0.11]


@query(f"""WITH {COMPLETE_SQL}, x AS (SELECT sep_bin, flux_bin, max(completeness) OVER (PARTITION BY sep_bin ORDER BY flux_bin) AS c, ln(sqrt({CONTRAST_EDGES}[flux_bin + 1]::DOUBLE * {CONTRAST_EDGES}[flux_bin + 2]::DOUBLE)) AS x FROM c),
    p AS (SELECT *, lag(c) OVER w AS c0, lag(x) OVER w AS x0 FROM x WINDOW w AS (PARTITION BY sep_bin ORDER BY flux_bin)) SELECT sep_bin, round(exp(min(CASE WHEN c >= 0.5 AND c0 < 0.5 THEN x0 + (0.5 - c0) / (c - c0) * (x - x0) WHEN c0 IS NULL AND c = 0.5 THEN x END)), 8) AS flux FROM p GROUP BY 1""")
def contrast_curve(spark, sf_dir):
    return rounded(detection.contrast_curve(_complete(spark, sf_dir), CONTRAST_EDGES), 8, "flux")


# Imaging -------------------------------------------------------------------------------------------------------------

CELLS = f"""{RADIO}, f AS (SELECT *, floor(u * s / 5e5) AS cu, floor(v * s / 5e5) AS cv FROM (SELECT *, CASE WHEN v < 0 OR (v = 0 AND u < 0) THEN -1 ELSE 1 END AS s FROM radio)), w AS (SELECT *, sum(weight) OVER (PARTITION BY cu, cv) AS cw FROM f),
    tot AS (SELECT sum(c * c) / sum(c) AS mean FROM (SELECT sum(weight) AS c FROM f GROUP BY cu, cv))"""


@query(f"WITH {CELLS} SELECT point_id, round(weight / cw, 9) AS imaging_weight FROM w")
def uniform_weights(spark, sf_dir):
    return rounded(imaging.imaging_weights(derived.radio(spark, sf_dir), 5e5, "uniform"), 9, "imaging_weight").select("point_id", "imaging_weight")


@query(f"WITH {CELLS} SELECT point_id, round(weight / (1 + cw * pow(5 * pow(10::DOUBLE, -0.5::DOUBLE), 2) / mean), 9) AS imaging_weight FROM w, tot")
def briggs_weights(spark, sf_dir):
    return rounded(imaging.imaging_weights(derived.radio(spark, sf_dir), 5e5, "briggs", 0.5), 9, "imaging_weight").select("point_id", "imaging_weight")


MAP_SQL = f"""{RADIO}, g AS (SELECT range AS pixel, (3.5::DOUBLE - range % 8) * 5 AS dra, (3.5::DOUBLE - range // 8) * 5 AS ddec FROM range(64)), t AS (SELECT pixel, weight AS w, re, im, (u * dra + v * ddec) * {2 * math.pi * MAS!r}::DOUBLE AS p FROM radio, g)"""


@query(f"WITH {MAP_SQL} SELECT pixel, round(sum(w * cos(p)) / sum(w), 8) AS value FROM t GROUP BY 1")
def dirty_beam(spark, sf_dir):
    return rounded(imaging.dirty_map(derived.radio(spark, sf_dir), imaging.pixels(spark, 8, 5.0), "weight", beam=True, n_pixels=64), 8, "value")


@query(f"WITH {MAP_SQL} SELECT pixel, round(sum(w * (re * cos(p) - im * sin(p))) / sum(w), 8) AS value FROM t GROUP BY 1")
def dirty_image(spark, sf_dir):
    return rounded(imaging.dirty_map(derived.radio(spark, sf_dir), imaging.pixels(spark, 8, 5.0), "weight", n_pixels=64), 8, "value")


@query(f"""WITH {SAMPLES}, g AS (SELECT (3.5::DOUBLE - range % 8) * 2 AS x, (3.5::DOUBLE - range // 8) * 2 AS y, exp(-(pow((3.5::DOUBLE - range % 8) * 2, 2) + pow((3.5::DOUBLE - range // 8) * 2, 2)) / 18) AS b FROM range(64)),
    i AS (SELECT x, y, b / (SELECT sum(b) FROM g) AS b FROM g) SELECT sample_id, round(sum(b * cos((u / wavel * x + v / wavel * y) * {2 * math.pi * MAS!r}::DOUBLE)), 7) + 0.0 AS re, round(-sum(b * sin((u / wavel * x + v / wavel * y) * {2 * math.pi * MAS!r}::DOUBLE)), 7) + 0.0 AS im FROM samples, i GROUP BY 1""")
def image_dft(spark, sf_dir):
    rows = derived.samples(spark, sf_dir).select("sample_id", (F.col("u") / F.col("wavel")).alias("u"), (F.col("v") / F.col("wavel")).alias("v"))
    out = imaging.image_dft(imaging.gaussian_blob(spark, 8, 2.0, 3.0), rows)
    # adding 0 turns a rounded -0 into 0
    return rounded(out, 7, "re", "im").withColumns({c: F.col(c) + 0.0 for c in ("re", "im")})


@query(f"""WITH {PIXELS}, d AS (SELECT *, coalesce(lead(value) OVER (PARTITION BY image, row ORDER BY col) - value, 0) AS dx, coalesce(lead(value) OVER (PARTITION BY image, col ORDER BY row) - value, 0) AS dy, sum(value) OVER (PARTITION BY image) AS f,
    count(*) OVER (PARTITION BY image) AS n FROM px) SELECT image, round(sum(dx * dx + dy * dy), 6) AS tsv, round(sum(sqrt(dx * dx + dy * dy + pow(f * 0.01::DOUBLE / sqrt(n::DOUBLE), 2))), 6) AS tv, round(sum(value * ln(value * n / f)), 6) AS entropy,
    round(sum(ln(1 + value * n / f / 0.01::DOUBLE)), 5) AS log_sum, round(sum(value), 6) AS flux FROM d GROUP BY 1""")
def image_regularisers(spark, sf_dir):
    return rounded(rounded(imaging.regularisers(derived.pixel_image(spark, sf_dir), ["image"]), 6, "tsv", "tv", "entropy", "flux"), 5, "log_sum")


@query(f"""WITH {PIXELS}, x AS (SELECT image, row + a AS r, col + b AS c, value * k AS v FROM px, (VALUES (0, 0, -4.0::DOUBLE), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1)) t(a, b, k)), s AS (SELECT image, r, c, sum(v) AS l FROM x GROUP BY ALL)
    SELECT image, round(sum(l * l), 5) AS laplacian FROM s GROUP BY 1""")
def laplacian_penalty(spark, sf_dir):
    return rounded(imaging.laplacian(derived.pixel_image(spark, sf_dir), ["image"]), 5, "laplacian")


@query(f"""WITH {RADIO}, m AS (SELECT sum(weight * u * u) / sum(weight) * {MAS**2!r}::DOUBLE AS uu, sum(weight * u * v) / sum(weight) * {MAS**2!r}::DOUBLE AS uv, sum(weight * v * v) / sum(weight) * {MAS**2!r}::DOUBLE AS vv FROM radio),
    c AS (SELECT vv / (uu * vv - uv * uv) / (4 * pi() * pi()) AS a, uu / (uu * vv - uv * uv) / (4 * pi() * pi()) AS c, -uv / (uu * vv - uv * uv) / (4 * pi() * pi()) AS b FROM m),
    e AS (SELECT (a + c) / 2 AS mid, sqrt(pow(a - c, 2) / 4 + b * b) AS half, degrees(atan2(2 * b, c - a) / 2) AS pa FROM c)
    SELECT round(sqrt(mid + half) * sqrt(8 * ln(2)), 6) AS major, round(sqrt(mid - half) * sqrt(8 * ln(2)), 6) AS minor, round(pa - floor(pa / 180) * 180, 5) AS pa FROM e""")
def beam_ellipse(spark, sf_dir):
    return rounded(rounded(imaging.beam(derived.radio(spark, sf_dir)), 6, "major", "minor"), 5, "pa")


@query(f"""WITH {SAMPLES}, s AS (SELECT pow(u / wavel, 2) + pow(v / wavel, 2) AS q, value, pow(value / error, 2) AS w FROM samples WHERE value >= 0.3)
    SELECT round(sqrt(2 * ln(2) * sum(w * q * -ln(value)) / sum(w * q * q)) / pi() / {MAS!r}::DOUBLE, 6) AS fwhm FROM s""")
def second_moment_fwhm(spark, sf_dir):
    rows = derived.samples(spark, sf_dir).withColumns({"u": F.col("u") / F.col("wavel"), "v": F.col("v") / F.col("wavel")})
    return rounded(imaging.second_moment_fwhm(rows), 6, "fwhm")


@query(f"""WITH {PIXELS} SELECT image, (row // 2)::INT AS row, (col // 2)::INT AS col, round(sum(value), 6) AS value FROM px GROUP BY ALL""")
def resample_image(spark, sf_dir):
    image = derived.pixel_image(spark, sf_dir)
    top = image.agg(F.greatest(F.max("row"), F.max("col")) + 1).first()[0]
    n = top + top % 2
    out = imaging.resample(image, 1.0, n, n // 2, 2.0, ("image",)).where("value > 0")
    return rounded(out, 6, "value").select("image", "row", "col", "value")


# Orbits --------------------------------------------------------------------------------------------------------------


def _span(spark, sf_dir) -> float:
    """Days from the first order to the last."""
    o = table(spark, sf_dir, "orders").select(F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).alias("d"))
    return float(o.agg(F.max("d") - F.min("d")).first()[0])


SPAN = "span AS (SELECT date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE)::DOUBLE AS s FROM orders)"


@query(f"""WITH {SPAN}, n AS (SELECT ceil((1 / 20.0::DOUBLE - 1 / 900.0::DOUBLE) * 9 * s) AS n FROM span)
    SELECT i, round(1 / (1 / 20.0::DOUBLE + i / n * (1 / 900.0::DOUBLE - 1 / 20.0::DOUBLE)), 8) AS period FROM (SELECT n, unnest(range(n::BIGINT + 1)) AS i FROM n)""")
def period_grid(spark, sf_dir):
    """Trial periods of 20 to 900 days over the span of all orders."""
    return rounded(orbits.period_grid(spark, _span(spark, sf_dir), 20.0, 900.0), 8, "period")


@query(f"""WITH {SPAN}, b AS (SELECT n, greatest(s / (n + 0.5::DOUBLE), 20) AS p_low, least(CASE WHEN n = 0 THEN 900 ELSE s / (n - 0.5::DOUBLE) END, 900) AS p_high
    FROM (SELECT s, unnest(range(floor(s / 900 + 0.5::DOUBLE)::BIGINT, floor(s / 20 + 0.5::DOUBLE)::BIGINT + 1)) AS n FROM span)) SELECT n, round(p_low, 8) AS p_low, round(p_high, 8) AS p_high FROM b WHERE p_low < p_high""")
def alias_bands(spark, sf_dir):
    """Bands of whole turns of 20 to 900 days over the span of all orders."""
    return rounded(orbits.alias_bands(spark, _span(spark, sf_dir), 20.0, 900.0), 8, "p_low", "p_high")


ORBIT = kepler.Kepler(period=700.0, t_peri=-120.0, ecc=0.3, inc=50.0, omega=60.0, Omega=120.0, a=20.0)


def _kepler_sql() -> str:
    w, o, i, a = math.radians(60), math.radians(120), math.radians(50), 20.0
    cw, sw, co, so, ci = math.cos(w), math.sin(w), math.cos(o), math.sin(o), math.cos(i)
    A, B, Fc, G = a * (cw * co - sw * so * ci), a * (cw * so + sw * co * ci), -a * (sw * co + cw * so * ci), -a * (sw * so - cw * co * ci)
    steps = "e0 AS (SELECT *, m + 0.3::DOUBLE * sin(m) AS e FROM b)"
    for k in range(10):
        steps += f", e{k + 1} AS (SELECT o_orderkey, m, e - (e - 0.3::DOUBLE * sin(e) - m) / (1 - 0.3::DOUBLE * cos(e)) AS e FROM e{k})"
    return f"""WITH a AS (SELECT o_orderkey, (date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + 120)::DOUBLE * 2 * pi() / 700 AS mm FROM orders), b AS (SELECT o_orderkey, mm + pi() - floor((mm + pi()) / (2 * pi())) * 2 * pi() - pi() AS m FROM a), {steps}
        SELECT o_orderkey, round({B!r}::DOUBLE * (cos(e) - 0.3::DOUBLE) + {G!r}::DOUBLE * sqrt(0.91::DOUBLE) * sin(e), 6) AS dra, round({A!r}::DOUBLE * (cos(e) - 0.3::DOUBLE) + {Fc!r}::DOUBLE * sqrt(0.91::DOUBLE) * sin(e), 6) AS ddec FROM e10"""


@query(_kepler_sql())
def kepler_positions(spark, sf_dir):
    t = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double")
    x, y = ORBIT.relative(t)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(x, 6).alias("dra"), F.round(y, 6).alias("ddec"))


def _trials(spark):
    return orbits.period_grid(spark, 100.0, 200.0, 900.0).select(F.col("i").alias("orbit_id"), "period", F.lit(0.0).alias("ecc"), F.lit(0.0).alias("t_peri"))


GRAM_SQL = f"""{EPOCHS}, p AS (SELECT range AS orbit_id, 1 / (1 / 200.0::DOUBLE + range / ceil((1 / 200.0::DOUBLE - 1 / 900.0::DOUBLE) * 900) * (1 / 900.0::DOUBLE - 1 / 200.0::DOUBLE)) AS period FROM range((ceil((1 / 200.0::DOUBLE - 1 / 900.0::DOUBLE) * 900) + 1)::BIGINT)),
    x AS (SELECT orbit_id, period, cos(2 * pi() * mjd / period) AS c, sin(2 * pi() * mjd / period) AS s, dra, ddec, 1 / (sigma * sigma) AS w FROM p, ep),
    g AS (SELECT orbit_id, period, sum(w * c * c) AS xx, sum(w * c * s) AS xy, sum(w * s * s) AS yy, sum(w * c * ddec) AS nx, sum(w * s * ddec) AS ny, sum(w * c * dra) AS ex, sum(w * s * dra) AS ey, sum(w * (dra * dra + ddec * ddec)) AS q FROM x GROUP BY 1, 2)"""


@query(f"WITH {GRAM_SQL} SELECT orbit_id, round(xx, 2) AS xx, round(xy, 2) AS xy, round(yy, 2) AS yy, round(nx, 2) AS nx, round(ny, 2) AS ny, round(ex, 2) AS ex, round(ey, 2) AS ey FROM g")
def thiele_innes_gram(spark, sf_dir):
    g = orbits.gram(derived.epochs(spark, sf_dir), _trials(spark))
    names = ["xx", "xy", "yy", "nx", "ny", "ex", "ey"]
    return rounded(g, 2, *names).select("orbit_id", *names)


@query(f"""WITH {GRAM_SQL} SELECT orbit_id, round(q - (yy * nx - xy * ny) / d * nx - (xx * ny - xy * nx) / d * ny - (yy * ex - xy * ey) / d * ex - (xx * ey - xy * ex) / d * ey, 2) AS chi2
    FROM (SELECT *, xx * yy - xy * xy AS d FROM g) ORDER BY chi2, orbit_id LIMIT 3""")
def starting_orbits(spark, sf_dir):
    return rounded(orbits.starting_orbits(derived.epochs(spark, sf_dir), _trials(spark), 3), 2, "chi2").select("orbit_id", "chi2")


@query(f"""WITH {SAMPLES}, o AS (SELECT user_id AS night, mjd, value AS x, error AS s, 10 * value - 8 AS y, row_number() OVER (PARTITION BY user_id ORDER BY mjd) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM samples),
    h AS (SELECT night, k > n // 2 AS late, avg(mjd) AS t, sum(x / (s * s)) / sum(1 / (s * s)) AS x, sum(y / (s * s)) / sum(1 / (s * s)) AS y FROM o GROUP BY 1, 2)
    SELECT a.night, round((a.t + b.t) / 2, 8) AS mjd, round((b.x - a.x) / (b.t - a.t), 6) AS vx, round((b.y - a.y) / (b.t - a.t), 6) AS vy FROM h a JOIN h b ON a.night = b.night AND NOT a.late AND b.late AND b.t > a.t""")
def night_motion(spark, sf_dir):
    rows = derived.samples(spark, sf_dir).select(F.col("user_id").alias("night"), "mjd", F.col("value").alias("dra"), (F.col("value") * 10 - 8).alias("ddec"), F.col("error").alias("sigma"))
    return rounded(rounded(orbits.night_motion(rows), 8, "mjd"), 6, "vx", "vy").select("night", "mjd", "vx", "vy")


@query("""WITH g AS (SELECT l_suppkey % 10 AS orbit, l_returnflag AS i, sum(1 / pow(l_quantity, 2)) AS w, sum((l_extendedprice / 1000 - 30) / pow(l_quantity, 2)) AS wr, sum(pow(l_extendedprice / 1000 - 30, 2) / pow(l_quantity, 2)) AS wrr, sum(-2 * ln(l_quantity)) AS lw, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT orbit, round(sum(-0.5::DOUBLE * (wrr - wr * wr / w) + 0.5::DOUBLE * lw - 0.5::DOUBLE * n * ln(2 * pi()) - 0.5::DOUBLE * ln(w) + 0.5::DOUBLE * ln(2 * pi())), 4) AS loglike FROM g GROUP BY 1""")
def rv_marginal_loglike(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("orbit"), F.col("l_returnflag").alias("instrument"), (F.col("l_extendedprice") / 1000 - 30).alias("residual"), F.col("l_quantity").alias("error"))
    return rounded(orbits.rv_marginal_loglike(rows, ["orbit"], "residual", "error"), 4, "loglike")


@query(f"WITH {SAMPLES}, b AS (SELECT user_id, event_type, count(*)::DOUBLE AS nu, sum(pow((value - 0.9) / error, 2)) AS c FROM samples GROUP BY 1, 2) SELECT user_id, round(sum(-0.5::DOUBLE * nu * ln(c)), 5) AS score FROM b GROUP BY 1")
def scale_marginal_score(spark, sf_dir):
    z = (F.col("value") - 0.9) / F.col("error")
    blocks = derived.samples(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("nu"), F.sum(z * z).alias("chi2"))
    return rounded(orbits.scale_marginal(blocks, ["user_id"]), 5, "score")


# Pipelines -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {SAMPLES}, c AS (SELECT user_id AS name, sum(pow((value - 0.9) / error, 2)) / count(*) AS value FROM samples GROUP BY 1) SELECT name, round(value, 6) AS value, CASE WHEN value <= 2 THEN 'pass' WHEN value <= 5 THEN 'warn' ELSE 'fail' END AS status FROM c""")
def checks_table(spark, sf_dir):
    z = (F.col("value") - 0.9) / F.col("error")
    c = derived.samples(spark, sf_dir).groupBy(F.col("user_id").alias("name")).agg((F.sum(z * z) / F.count("*")).alias("value"))
    return rounded(c.withColumn("status", checks.rule(F.col("value"), 2.0, 5.0)), 6, "value").select("name", "value", "status")


@query(f"""WITH {SAMPLES}, c AS (SELECT user_id % 7 AS grp, CASE WHEN sum(pow((value - 0.9) / error, 2)) / count(*) <= 2 THEN 0 WHEN sum(pow((value - 0.9) / error, 2)) / count(*) <= 5 THEN 1 ELSE 2 END AS s FROM samples GROUP BY user_id)
    SELECT grp, ['pass', 'warn', 'fail'][max(s) + 1] AS status FROM c GROUP BY 1""")
def worst_status(spark, sf_dir):
    z = (F.col("value") - 0.9) / F.col("error")
    c = derived.samples(spark, sf_dir).groupBy("user_id").agg((F.sum(z * z) / F.count("*")).alias("value")).select((F.col("user_id") % 7).alias("grp"), checks.rule(F.col("value"), 2.0, 5.0).alias("status"))
    return checks.worst(c, ["grp"])


# Further scalar functions and models ---------------------------------------------------------------------------------


@query(f"WITH {SAMPLES}, b AS (SELECT sqrt(u * u + v * v) / wavel AS b FROM samples) SELECT round({180 * 3600e3 / math.pi!r}::DOUBLE / max(b), 6) AS finest, round({180 * 3600e3 / math.pi!r}::DOUBLE / min(b) FILTER (b > 0), 6) AS coarsest FROM b")
def fringe_scales(spark, sf_dir):
    return rounded(select.fringe_scales(derived.samples(spark, sf_dir)), 6, "finest", "coarsest")


@query(f"""WITH {SAMPLES} SELECT channel, round(avg(0.2::DOUBLE * pow(wavel / 1.65e-6::DOUBLE, -1.5::DOUBLE)), 9) AS power_law, round(avg(pow(wavel / 1.65e-6::DOUBLE, -5) * (exp({photometry.HC_K!r}::DOUBLE / 1.65e-6::DOUBLE / 1500) - 1) / (exp({photometry.HC_K!r}::DOUBLE / wavel / 1500) - 1)), 6) AS black_body,
    round(avg(exp(-4 * ln(2::DOUBLE) * pow((wavel - 3.2e-6::DOUBLE) / 2e-7::DOUBLE, 2))), 9) AS gaussian_line, round(avg(1 / (1 + 4 * pow((wavel - 3.2e-6::DOUBLE) / 2e-7::DOUBLE, 2))), 9) AS lorentzian_line FROM samples GROUP BY 1""")
def spectra_by_channel(spark, sf_dir):
    w = F.col("wavel")
    parts = {"power_law": photometry.power_law(0.2, -1.5, w), "black_body": photometry.black_body(1.0, 1500.0, w), "gaussian_line": photometry.gaussian_line(1.0, 3.2e-6, 2e-7, w), "lorentzian_line": photometry.lorentzian_line(1.0, 3.2e-6, 2e-7, w)}
    return derived.samples(spark, sf_dir).groupBy("channel").agg(*(F.round(F.avg(c), 6 if n == "black_body" else 9).alias(n) for n, c in parts.items()))


@query("""WITH c AS (SELECT l_suppkey, l_linenumber AS chain, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT l_suppkey, avg(v) AS w, var_samp(m) AS b, avg(n) AS n FROM c GROUP BY 1)
    SELECT l_suppkey, round(sqrt((w * (n - 1) / n + b) / w), 6) AS r_hat FROM g""")
def r_hat_sites(spark, sf_dir):
    draws = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("chain"), F.col("l_extendedprice").alias("value"))
    return rounded(checks.r_hat(draws, ["l_suppkey"]), 6, "r_hat")


@query(f"WITH {RADIO} SELECT point_id, round(weight * exp(-(u * u + v * v) * {(math.pi * 20.0 * MAS) ** 2 / (4 * math.log(2))!r}::DOUBLE), 9) AS imaging_weight FROM radio")
def tapered_weights(spark, sf_dir):
    return rounded(imaging.imaging_weights(derived.radio(spark, sf_dir), 5e5, "natural", taper_fwhm=20.0), 9, "imaging_weight").select("point_id", "imaging_weight")


@query(f"""WITH {SAMPLES}, a AS (SELECT r AS ratio, value, error, u / wavel * sin(radians(30)) + v / wavel * cos(radians(30)) AS y, (u / wavel * cos(radians(30)) - v / wavel * sin(radians(30))) * r AS x FROM samples, unnest([0.3::DOUBLE, 0.6, 1.0]) q(r)),
    m AS (SELECT ratio, value, error, exp((x * x + y * y) * {-2 * math.pi**2 * (2.0 * MAS) ** 2 / (8 * math.log(2))!r}::DOUBLE) AS v FROM a) SELECT ratio, round(-0.5::DOUBLE * sum(pow((v * v - value) / error, 2)), 3) AS loglike FROM m GROUP BY 1""")
def elliptical_gaussian_grid(spark, sf_dir):
    points = grid.axes(spark, ratio=[0.3, 0.6, 1.0])
    out = grid.likelihood_grid(derived.samples(spark, sf_dir), points, models.EllipticalGaussian(fwhm=2.0, ratio="ratio", pa=30.0), n_points=3)
    return rounded(out, 3, "loglike").join(F.broadcast(points), "point_id").select("ratio", "loglike")


@query(f"""WITH {SAMPLES}, o AS (SELECT p AS period, value, error, u / wavel AS u, v / wavel AS v, 2 * pi() * (mjd - 3) / p AS m FROM samples, unnest([5.0::DOUBLE, 11, 40]) q(p)),
    f AS (SELECT period, value, error, (u * 4 * sin(m) + v * 4 * cos(m)) * {K2} AS p FROM o), g AS (SELECT period, value, error, pow((1 + 0.2::DOUBLE * cos(p)) / 1.2::DOUBLE, 2) + pow(0.2::DOUBLE * sin(p) / 1.2::DOUBLE, 2) AS v FROM f)
    SELECT period, round(-0.5::DOUBLE * sum(pow((v - value) / error, 2)), 3) AS loglike FROM g GROUP BY 1""")
def orbital_binary_grid(spark, sf_dir):
    """A companion on a circle at each sample's own time, scored for three periods."""
    points = grid.axes(spark, period=[5.0, 11.0, 40.0])
    model = models.OrbitalBinary(orbit=kepler.Kepler(period="period", t_peri=3.0, a=4.0), ratio=0.2)
    term = grid.chi2_terms(model, uv=models.samples_uv(mjd=True))
    out = grid.evaluate(derived.samples(spark, sf_dir), points, {"chi2": term}, n_points=3)
    return out.join(F.broadcast(points), "point_id").select("period", F.round(F.col("chi2") * -0.5, 3).alias("loglike"))


@query(f"""WITH {SAMPLES}, f AS (SELECT b AS width, value, error, (u / wavel * 6 + v / wavel * 3) * {K2} AS p, (u / wavel * 6 + v / wavel * 3) * {MAS!r}::DOUBLE * b / wavel AS x FROM samples, unnest([1e-8::DOUBLE, 2e-7, 5e-7]) q(b)),
    g AS (SELECT *, 0.1::DOUBLE * CASE WHEN x = 0 THEN 1 ELSE sin(pi() * x) / (pi() * x) END AS s FROM f), h AS (SELECT width, value, error, pow((1 + s * cos(p)) / 1.1::DOUBLE, 2) + pow(s * sin(p) / 1.1::DOUBLE, 2) AS v FROM g)
    SELECT width, round(-0.5::DOUBLE * sum(pow((v - value) / error, 2)), 3) AS loglike FROM h GROUP BY 1""")
def smeared_binary_grid(spark, sf_dir):
    """The same binary seen through channels of three widths."""
    points = grid.axes(spark, width=[1e-8, 2e-7, 5e-7])
    s = models.samples_uv()
    uv = models.Uv(s.u, s.v, s.wavel, None, F.col("width"))
    out = grid.evaluate(derived.samples(spark, sf_dir), points, {"chi2": grid.chi2_terms(models.BinaryCartesian(x=6.0, y=3.0, ratio=0.1), uv=uv)}, n_points=3)
    return out.join(F.broadcast(points), "point_id").select("width", F.round(F.col("chi2") * -0.5, 3).alias("loglike"))


@query(f"""SELECT p_partkey, round(pow(p_size * 2.0::DOUBLE * {kepler.AU!r}::DOUBLE / 100, 3) * {4 * math.pi**2 / kepler.GM_SUN!r}::DOUBLE / pow(p_retailprice * 86400, 2), 9) AS mass FROM part""")
def kepler_masses(spark, sf_dir):
    """Kepler's third law at 20 parsecs, sizes as axes in mas and prices as periods in days."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(kepler.total_mass(F.col("p_size").cast("double"), F.col("p_retailprice"), 20.0), 9).alias("mass"))


@query(f"""WITH {EPOCHS}, r AS (SELECT k AS orbit, dra - 2 * sin(mjd / k) AS x, ddec - 2 * cos(mjd / k) AS y FROM ep, unnest([50.0::DOUBLE, 90, 200]) q(k))
    SELECT orbit, round(sum(-0.5::DOUBLE * (0.5::DOUBLE * x * x - 0.4::DOUBLE * x * y + 0.8::DOUBLE * y * y) / 0.36::DOUBLE - 0.5::DOUBLE * ln(0.36::DOUBLE) - ln(2 * pi())), 3) AS loglike FROM r GROUP BY 1""")
def position_loglike(spark, sf_dir):
    """Positions with a full 2 x 2 covariance against three circular orbits."""
    rows = derived.epochs(spark, sf_dir).withColumn("orbit", F.explode(F.array(F.lit(50.0), F.lit(90.0), F.lit(200.0))))
    rows = rows.withColumn("cov", F.struct(F.lit(0.8).alias("xx"), F.lit(0.2).alias("xy"), F.lit(0.5).alias("yy")))
    t = F.col("mjd") / F.col("orbit")
    return rounded(orbits.position_loglike(rows, F.col("dra") - F.sin(t) * 2.0, F.col("ddec") - F.cos(t) * 2.0, ["orbit"]), 3, "loglike")


from . import catalogue_search, catalogue_sky  # noqa: E402, F401  register further queries
