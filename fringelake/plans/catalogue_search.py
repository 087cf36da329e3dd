"""The catalogue's searches: limits by brackets, lattices, marginal nuisances and their SQL in closed form."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import harmonics
from ..functions.cx import real
from ..functions.geometry import offset_phase
from ..operators import arcs, gridding, imaging, orbits
from ..operators.lattice import Lattice
from ..sources import oifits_source
from . import cleaning, derived, grid, injection, limits, models, particles
from .arrow import Arrow, station_modes
from .catalogue import AXES, K2, MAS, log_gamma_tail, noise_of, noise_sql, query, rounded
from .derived import BASELINES, PIXELS, RADIO, SAMPLES
from .work import shared_dir

# Limits --------------------------------------------------------------------------------------------------------------


#: ln of twice the normal tail beyond three standard deviations, and the flux ladder of a quarter of a decade.
TAIL, LOW, STEPS = math.log(math.erfc(3 / math.sqrt(2))), -4.0, 16


def _limits_sql(held: str) -> str:
    """The chi-square of every flux from three sums of each position, the ratio of 3 sigma by halving, and the crossing by halving."""
    return f"""WITH RECURSIVE {SAMPLES}, held AS (SELECT u, v, wavel, error, value AS seen, {held} AS d FROM samples),
    pts AS (SELECT x AS dra, y AS ddec FROM unnest([-10.0::DOUBLE, -5, 5, 10]) a(x), unnest([-10.0::DOUBLE, -5, 0, 5, 10]) b(y)),
    ph AS (SELECT dra, ddec, d, seen, error, cos(((u / wavel) * dra + (v / wavel) * ddec) * {K2}) AS c FROM held, pts),
    s AS (SELECT dra, ddec, sum(pow((1 - d) / error, 2)) AS a, sum((c - d) * (1 - d) / (error * error)) AS b, sum(pow((c - d) / error, 2)) AS k, sum(pow((1 - seen) / error, 2)) AS base, count(*) AS n FROM ph GROUP BY ALL),
    size AS (SELECT max(n) / 2.0::DOUBLE AS h FROM s),
    ratio AS (SELECT 0 AS i, 1.0::DOUBLE AS lo, 2.0::DOUBLE AS hi, h FROM size UNION ALL
        SELECT i + 1, CASE WHEN hit THEN lo ELSE (lo + hi) / 2 END, CASE WHEN hit THEN (lo + hi) / 2 ELSE hi END, h FROM (SELECT *, {log_gamma_tail('h', 'h * (lo + hi) / 2')} <= {TAIL!r} AS hit FROM ratio WHERE i < 50)),
    least AS (SELECT s.*, hi * base AS least FROM s, ratio WHERE i = 50),
    rungs AS (SELECT l.*, k.k AS rung, pow(10, {LOW} + k.k * 0.25::DOUBLE) AS f FROM least l, range({STEPS} + 1) k(k)),
    up AS (SELECT dra, ddec, any_value(a) AS a, any_value(b) AS b, any_value(rungs.k) AS k, any_value(least) AS least,
        min(rung) FILTER (a * pow(1 + f * f, 2) + 4 * f * (1 + f * f) * b + 4 * f * f * rungs.k >= least * pow(1 + f, 4)) AS rung FROM rungs GROUP BY ALL),
    halves AS (SELECT 0 AS i, *, {LOW} + (rung - 1) * 0.25::DOUBLE AS lo, {LOW} + rung * 0.25::DOUBLE AS hi FROM up UNION ALL
        SELECT i + 1, dra, ddec, a, b, k, least, rung, CASE WHEN hit THEN lo ELSE m END, CASE WHEN hit THEN m ELSE hi END FROM (SELECT *, (lo + hi) / 2 AS m, pow(10, (lo + hi) / 2) AS f,
            a * pow(1 + f * f, 2) + 4 * f * (1 + f * f) * b + 4 * f * f * k >= least * pow(1 + f, 4) AS hit FROM halves WHERE i < 22))
    SELECT dra, ddec, CASE WHEN rung IS NULL THEN 'above' WHEN rung = 0 THEN 'below' ELSE 'crossed' END AS side, CASE WHEN rung > 0 THEN round(pow(10, (lo + hi) / 2), 7) END AS flux_limit FROM halves WHERE i = 22"""


CELLS = {"dra": [-10.0, -5.0, 5.0, 10.0], "ddec": AXES["ddec"]}
BOUNDS = (10.0**LOW, 10.0 ** (LOW + STEPS / 4))
SINGLE = models.PointSource()
COMPANION = models.BinaryCartesian(x="dra", y="ddec", ratio="flux")


def _shown(found, cells):
    return found.join(F.broadcast(cells), "point_id").select("dra", "ddec", "side", F.round("limit", 7).alias("flux_limit"))


@query(_limits_sql("value"))
def absil_limits(spark, sf_dir):
    """Flux at which a companion is excluded at 3 sigma, by rounds over a table of brackets."""
    cells = grid.axes(spark, **CELLS)
    found = limits.absil_limits(derived.samples(spark, sf_dir), cells, COMPANION, SINGLE, 3.0, bounds=BOUNDS)
    return found.select("dra", "ddec", "side", F.round("limit", 7).alias("flux_limit"))


@query(_limits_sql("2 - value"))
def injection_limits(spark, sf_dir):
    """Flux at which a companion put into the data is detected at 3 sigma, by rounds over a table of brackets."""
    cells = grid.axes(spark, **CELLS)
    found = limits.injection_limits(derived.samples(spark, sf_dir), cells, COMPANION, SINGLE, 3.0, bounds=BOUNDS)
    return found.select("dra", "ddec", "side", F.round("limit", 7).alias("flux_limit"))


@query(_limits_sql("value"))
def absil_limits_one_pass(spark, sf_dir):
    """The same limits from the sums of one pass, of which the chi-square of every flux is a polynomial."""
    cells = grid.axes(spark, **CELLS)
    s = models.samples_uv()
    sums = limits.companion_sums(derived.samples(spark, sf_dir), cells, offset_phase(s.u, s.v, "dra", "ddec"), real(1.0), n_points=20)
    return _shown(limits.limits_from_sums(sums, 3.0, BOUNDS), cells)


# Sums over grids -----------------------------------------------------------------------------------------------------

#: Pixels in mas for the images of the parts table, whose side is that of the largest image.
SIDE, SCALE = "(SELECT max(greatest(row, col)) + 1 FROM px)", 5.0


def _side(px) -> int:
    return max(_shape(px))


def _shape(px) -> tuple[int, int]:
    """Rows and columns of the images."""
    rows, cols = px.agg(F.max("row"), F.max("col")).first()
    return rows + 1, cols + 1


@query(f"""WITH {RADIO}, {PIXELS}, uv AS (SELECT DISTINCT u, v FROM radio), side AS (SELECT {SIDE} AS n),
    m AS (SELECT image, u, v, sum(value * cos(p)) AS mr, -sum(value * sin(p)) AS mi FROM (SELECT image, u, v, value / 1000.0::DOUBLE AS value, (u * ((n - 1) / 2.0::DOUBLE - col) + v * ((n - 1) / 2.0::DOUBLE - row)) * {SCALE * 2 * math.pi * MAS!r}::DOUBLE AS p FROM px, uv, side) GROUP BY ALL)
    SELECT image, ddid, count(*) AS n, round(sum(weight * (pow(re - mr, 2) + pow(im - mi, 2))) / count(*), 5) AS chi2 FROM radio JOIN m USING (u, v) GROUP BY ALL""")
def toeplitz_chi2(spark, sf_dir):
    """Ten images against every visibility by spectral window, from the lattice of pixel differences."""
    px = derived.pixel_image(spark, sf_dir)
    shape = _shape(px)
    lattice = Lattice.of(derived.radio(spark, sf_dir), max(shape), SCALE, shape=shape)
    return lattice.chi2(px, gain=1e-3).select("image", "ddid", "n", F.round(F.col("chi2") / F.col("n"), 5).alias("chi2"))


@query(f"""WITH {SAMPLES}, {PIXELS}, side AS (SELECT {SIDE} AS n), im AS (SELECT row, col, sum(value) / sum(sum(value)) OVER () AS value FROM px GROUP BY ALL), uv AS (SELECT DISTINCT u, v, wavel FROM samples),
    m AS (SELECT u, v, wavel, sum(value * cos(p)) AS re, -sum(value * sin(p)) AS im FROM (SELECT u, v, wavel, value, (u / wavel * ((n - 1) / 2.0::DOUBLE - col) + v / wavel * ((n - 1) / 2.0::DOUBLE - row)) * {SCALE * 2 * math.pi * MAS!r}::DOUBLE AS p FROM im, uv, side) GROUP BY ALL)
    SELECT channel, count(*) AS n, round(avg(re), 6) AS re, round(avg(im), 6) AS im, round(avg(re * re + im * im), 6) AS v2 FROM samples JOIN m USING (u, v, wavel) GROUP BY 1""")
def gridded_visibilities(spark, sf_dir):
    """The transform of the parts' summed image at every sample's baseline, by a compact kernel on a fine grid."""
    px = derived.pixel_image(spark, sf_dir)
    one = imaging.unit_sum(px.groupBy("row", "col").agg(F.sum("value").alias("value")))
    shape = _shape(px)
    s = derived.samples(spark, sf_dir).where("u is not null and v is not null").withColumns({"u": F.col("u") / F.col("wavel"), "v": F.col("v") / F.col("wavel")})
    uv = s.groupBy("channel", "u", "v").agg(F.count("*").alias("n")).select(F.struct("channel", "n").alias("at"), "u", "v")
    z = gridding.image_visibilities(one, uv, max(shape), SCALE, id="at", shape=shape).select("at.*", "re", "im")
    mean = lambda x: F.sum(F.col("n") * x) / F.sum("n")
    out = z.groupBy("channel").agg(F.sum("n").alias("n"), mean(F.col("re")).alias("re"), mean(F.col("im")).alias("im"), mean(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("v2"))
    return rounded(out, 6, "re", "im", "v2")


# Marginal nuisances --------------------------------------------------------------------------------------------------


def _arrow_sql() -> str:
    """Gram entries in long form, swept one pivot at a time: the stations of every frame, then the spanning columns."""
    a = "CASE WHEN k < 3 THEN 0 WHEN k < 5 THEN 1 ELSE 2 END"
    b = "CASE WHEN k < 3 THEN k + 1 WHEN k < 5 THEN k - 1 ELSE 3 END"
    ctes = f"""WITH {SAMPLES}, r AS (SELECT sample_id, sample_id // 6 AS frame, sample_id % 6 AS k, (value - 0.5::DOUBLE) / error AS x, 0.5::DOUBLE * 0.2::DOUBLE / error AS gain, 0.3::DOUBLE / error AS s1, 0.2::DOUBLE * (wavel / 3e-6::DOUBLE - 1) / error AS s2 FROM samples),
    long AS (SELECT sample_id, frame, {a} AS i, gain AS v FROM r UNION ALL SELECT sample_id, frame, {b}, gain FROM r UNION ALL SELECT sample_id, frame, 4, s1 FROM r UNION ALL SELECT sample_id, frame, 5, s2 FROM r UNION ALL SELECT sample_id, frame, 6, x FROM r),
    here AS (SELECT DISTINCT frame, i FROM long), met AS (SELECT p.frame, p.i, q.i AS j, sum(p.v * q.v) AS v FROM long p JOIN long q USING (sample_id) GROUP BY ALL),
    pairs AS (SELECT a.frame, a.i, b.i AS j, coalesce(v, 0) AS v FROM here a JOIN here b ON a.frame = b.frame LEFT JOIN met m ON m.frame = a.frame AND m.i = a.i AND m.j = b.i),
    g0 AS (SELECT scale2, frame, i, j, v + CASE WHEN i = j AND i < 4 THEN scale2 ELSE 0 END AS v FROM pairs, unnest([0.5::DOUBLE, 1, 4]) t(scale2))"""
    sweep = lambda source, k, key: f"SELECT e.{key.replace(', ', ', e.')}, e.i, e.j, e.v - coalesce(l.v * u.v / p.v, 0) AS v FROM {source} e LEFT JOIN {source} p ON p.i = {k} AND p.j = {k} AND {' AND '.join(f'p.{x} = e.{x}' for x in key.split(', '))} LEFT JOIN {source} l ON l.i = e.i AND l.j = {k} AND {' AND '.join(f'l.{x} = e.{x}' for x in key.split(', '))} LEFT JOIN {source} u ON u.i = {k} AND u.j = e.j AND {' AND '.join(f'u.{x} = e.{x}' for x in key.split(', '))} WHERE e.i > {k} AND e.j > {k}"
    for k in range(4):
        ctes += f", g{k + 1} AS ({sweep(f'g{k}', k, 'scale2, frame')})"
    ctes += ", h4 AS (SELECT scale2, i, j, sum(v) + CASE WHEN i = j AND i < 6 THEN scale2 ELSE 0 END AS v FROM g4 GROUP BY scale2, i, j)"
    for k in (4, 5):
        ctes += f", h{k + 1} AS ({sweep(f'h{k}', k, 'scale2')})"
    pivots = " UNION ALL ".join([f"SELECT scale2, v FROM g{k} WHERE i = {k} AND j = {k}" for k in range(4)] + [f"SELECT scale2, v FROM h{k} WHERE i = {k} AND j = {k}" for k in (4, 5)])
    return f"""{ctes}, n AS (SELECT scale2, 0.5::DOUBLE * sum(ln(v) - ln(scale2)) AS norm FROM ({pivots}) GROUP BY 1)
    SELECT h6.scale2, round(v / h6.scale2, 4) AS chi2, round(norm, 5) AS norm, round(-0.5::DOUBLE * v / h6.scale2 - norm - 0.5::DOUBLE * (SELECT count(*) FROM samples) * ln(2 * pi() * h6.scale2), 4) AS loglike FROM h6 JOIN n USING (scale2)"""


@query(_arrow_sql())
def gain_marginal_loglike(spark, sf_dir):
    """Four stations' gains in every frame and two scales over all frames, marginalised at three noise scales."""
    s, b = derived.samples(spark, sf_dir), derived.baselines(spark, sf_dir).drop("phi")
    rows = s.join(b, "sample_id").withColumn("model", F.lit(0.5))
    rows = rows.select(((F.col("value") - 0.5) / F.col("error")).alias("x"), F.col("frame").alias("block"), station_modes(0.1).alias("modes"), (0.3 / F.col("error")).alias("s1"), ((F.col("wavel") / 3e-6 - 1.0) * 0.2 / F.col("error")).alias("s2"))
    arrow = Arrow.of(rows, spanning=("s1", "s2"))
    found = [(t, *(round(v, d) for v, d in zip(arrow.at(t).values(), (4, 5, 4)))) for t in (0.5, 1.0, 4.0)]
    return spark.createDataFrame(found, "scale2 double, chi2 double, norm double, loglike double")


# Orbits --------------------------------------------------------------------------------------------------------------


@query()
def cycle_counts(spark, sf_dir):
    """Periods between 200 and 1,000 days that yearly means of all orders admit, and the bands of whole turns among them."""
    o = derived.table(spark, sf_dir, "orders")
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double")
    years = o.groupBy(F.year("o_orderdate").alias("year")).agg(F.avg(day).alias("mjd"), (F.avg("o_totalprice") / 2000.0).alias("dra"), (F.avg("o_custkey") / 10.0).alias("ddec"), F.lit(0.5).alias("sxx"), F.lit(0.1).alias("sxy"), F.lit(0.4).alias("syy"))
    arc = arcs.arc_of(years)
    found, _ = arcs.unwrap_cycles(spark, arc, (200.0, 1000.0), eccs=[0.0, 0.3, 0.6])
    bands = orbits.alias_bands(spark, float(arc.t.max() - arc.t.min()), 200.0, 1000.0)
    return arcs.admitted_bands(bands, found).select("n", F.round("p_low", 4).alias("p_low"), F.round("p_high", 4).alias("p_high"))


# Particles -----------------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT o_orderkey, floor(exp(ln(o_totalprice) - max(ln(o_totalprice)) OVER ()) * 1099511627776 + 0.5)::HUGEINT AS units, count(*) OVER () AS n FROM orders),
    p AS (SELECT *, sum(units) OVER (ORDER BY o_orderkey % 64, o_orderkey)::HUGEINT AS upto, sum(units) OVER ()::HUGEINT AS total FROM w),
    x AS (SELECT *, floor(total * 0.5::DOUBLE)::HUGEINT AS start FROM p)
    SELECT o_orderkey, (greatest(0, (upto * n - start + total - 1) // total) - greatest(0, ((upto - units) * n - start + total - 1) // total))::BIGINT AS draws FROM x""")
def resampled_particles(spark, sf_dir):
    """As many systematic draws from the orders as there are, by their price."""
    o = derived.table(spark, sf_dir, "orders").select("o_orderkey", F.log("o_totalprice").alias("lw"))
    found = particles.resample(o, "lw", o.count(), id="o_orderkey", offset=0.5, slice_of=F.pmod("o_orderkey", F.lit(64)))
    return found.select("o_orderkey", "draws")


# Injection -----------------------------------------------------------------------------------------------------------

_FLUX_LADDER = [0.003, 0.01, 0.03]
_PLANTED = [(0, 10.0, 5.0, 0.02), (1, -5.0, 10.0, 0.02), (2, 5.0, -10.0, 0.004), (3, 10.0, -5.0, 0.004)]
@query(f"""WITH {SAMPLES}, draws(k, tx, ty, tf) AS (VALUES {', '.join(f'({k}, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE)' for k in range(4))}, {', '.join(f'({4 + k}, {x}::DOUBLE, {y}::DOUBLE, {f}::DOUBLE)' for k, x, y, f in _PLANTED)}),
    p AS (SELECT sample_id, u / wavel AS p, v / wavel AS q, error FROM samples),
    d AS (SELECT sample_id, p, q, error, k, (1 + 2 * tf * cos((p * tx + q * ty) * {K2}) + tf * tf) / pow(1 + tf, 2) + error * {noise_sql('k', 'sample_id')} AS d FROM p, draws),
    pts AS (SELECT x, y FROM unnest([-10.0::DOUBLE, -5, 5, 10]) a(x), unnest([-10.0::DOUBLE, -5, 0, 5, 10]) b(y)),
    g AS (SELECT k, x, y, f, sum(pow((1 - d) / error, 2) - pow(((1 + 2 * f * c + f * f) / pow(1 + f, 2) - d) / error, 2)) AS gain FROM (SELECT d.*, x, y, cos((p * x + q * y) * {K2}) AS c FROM d, pts), unnest({_FLUX_LADDER}::DOUBLE[]) t(f) GROUP BY ALL),
    b AS (SELECT k, greatest(max(gain), 0) AS delta_chi2, arg_max([x, y, f], gain) AS best FROM g GROUP BY 1)
    SELECT k::BIGINT AS draw, round(delta_chi2, 3) AS delta_chi2, CASE WHEN delta_chi2 > 0 THEN abs(best[1]) END AS dra, CASE WHEN delta_chi2 > 0 THEN best[2] * sign(best[1]) END AS ddec, CASE WHEN delta_chi2 > 0 THEN best[3] END AS flux FROM b""")
def injection_recovery(spark, sf_dir):
    """Four observations of a star alone and four with a companion, simulated at every sample and searched on a grid."""
    planted = spark.createDataFrame(_PLANTED, "draw long, dra double, ddec double, flux double")
    found = injection.recovery(derived.samples(spark, sf_dir), planted, 4, grid.axes(spark, **CELLS), _FLUX_LADDER, noise=noise_of)
    # a place and its reflection are one
    return found.select("draw", F.round("delta_chi2", 3).alias("delta_chi2"), F.abs("dra").alias("dra"), (F.col("ddec") * F.signum("dra")).alias("ddec"), "flux")


# Harmonics -----------------------------------------------------------------------------------------------------------

_C, _S, _INC, _PA, _OPENING = (0.4, -0.2, 0.1), (0.1, 0.3, 0.0), 50.0, 30.0, 0.2


def _multipole_sql() -> str:
    """Every ring of the profile as 64 points of its azimuth, on the distinct baselines."""
    x, w = (a.tolist() for a in np.polynomial.legendre.leggauss(16))
    nodes = ", ".join(f"({2 + 2 * (a + 1)!r}::DOUBLE, {2 * b!r}::DOUBLE)" for a, b in zip(x, w))
    bright = "1 + " + " + ".join(f"({c} * cos({m + 1} * t) + {s} * sin({m + 1} * t))" for m, (c, s) in enumerate(zip(_C, _S)))
    i, p = math.radians(_INC), math.radians(_PA)
    return f"""WITH {SAMPLES}, uv AS (SELECT channel, wavel, u / wavel AS p, v / wavel AS q, count(*) AS n FROM samples GROUP BY ALL),
    rings AS (SELECT r, w * r * exp(-0.5 * pow((r - 4) / 0.4, 2)) AS w FROM (VALUES {nodes}) z(r, w)),
    spots AS (SELECT w * ({bright}) AS b, r * cos(t) AS a, r * sin(t) * {math.cos(i)!r}::DOUBLE + r * {_OPENING * math.sin(i)!r}::DOUBLE AS o FROM rings, (SELECT k * 2 * pi() / 64 AS t FROM range(64) k(k))),
    sky AS (SELECT b / sum(b) OVER () AS b, a * {math.sin(p)!r}::DOUBLE + o * {math.cos(p)!r}::DOUBLE AS e, a * {math.cos(p)!r}::DOUBLE - o * {math.sin(p)!r}::DOUBLE AS north FROM spots),
    z AS (SELECT channel, p, q, any_value(n) AS n, sum(b * cos((p * e + q * north) * {K2})) AS re, sum(b * sin((p * e + q * north) * {K2})) AS im FROM uv, sky GROUP BY channel, p, q)
    SELECT channel, round(sum(n * (re * re + im * im)) / sum(n), 6) AS v2, round(sum(n * re) / sum(n), 6) AS re, round(sum(n * im) / sum(n), 6) AS im FROM z GROUP BY 1"""


@query(_multipole_sql())
def multipole_disk(spark, sf_dir):
    """A flared disk with three azimuthal orders, on the samples' distinct baselines and averaged by channel."""
    disk = models.MultipoleDisk(profile=models.GaussianRing(radius=4.0, sigma=0.4, nodes=16), c=_C, s=_S, inc=_INC, pa=_PA, opening=_OPENING)
    uv = derived.samples(spark, sf_dir).groupBy("channel", "u", "v", "wavel").agg(F.count("*").alias("n"))
    z = disk.cvis(models.samples_uv())
    rows = uv.select("channel", "n", z.re.alias("re"), z.im.alias("im"))
    mean = lambda x: F.sum(F.col("n") * x) / F.sum("n")
    out = rows.groupBy("channel").agg(mean(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("v2"), mean(F.col("re")).alias("re"), mean(F.col("im")).alias("im"))
    return rounded(out, 6, "v2", "re", "im")


@query("SELECT p_partkey, round(v[1], 7) AS i1_re, round(v[2], 7) AS i1_im, round(pow(v[3], 2) + pow(v[4], 2), 7) AS i2_power FROM (SELECT p_partkey, [" + ", ".join(f"list_sum(list_transform(range(256), lambda k: {f}({m} * k * 2 * pi() / 256) * exp(kappa * (cos(k * 2 * pi() / 256 - t0) - 1)))) * {s} / norm" for m in (1, 2) for f, s in (("cos", 1), ("sin", -1))) + "] AS v FROM (SELECT p_partkey, p_retailprice / 500.0::DOUBLE AS kappa, p_size / 10.0::DOUBLE AS t0, list_sum(list_transform(range(256), lambda k: exp(p_retailprice / 500.0::DOUBLE * (cos(k * 2 * pi() / 256 - p_size / 10.0::DOUBLE) - 1)))) AS norm FROM part))")
def von_mises_profiles(spark, sf_dir):
    """The first two harmonics of a von Mises profile for every part: price as concentration, size as direction."""
    h = harmonics.von_mises_harmonics(F.col("p_retailprice") / 500.0, F.col("p_size") / 10.0, 2)
    rows = derived.table(spark, sf_dir, "part").select("p_partkey", h.alias("h"))
    power = F.pow(F.get("h", F.lit(2))["re"], 2.0) + F.pow(F.get("h", F.lit(2))["im"], 2.0)
    return rows.select("p_partkey", F.round(F.get("h", F.lit(1))["re"], 7).alias("i1_re"), F.round(F.get("h", F.lit(1))["im"], 7).alias("i1_im"), F.round(power, 7).alias("i2_power"))


# Searches of bands and fields, over tables ---------------------------------------------------------------------------


@query("""WITH s AS (SELECT o_custkey, max(d) - min(d) AS span FROM (SELECT o_custkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS d FROM orders) GROUP BY 1 HAVING max(d) > min(d))
    SELECT o_custkey, count(*) AS bands, round(sum(least(CASE WHEN n = 0 THEN 400 ELSE span / (n - 0.5::DOUBLE) END, 400) - greatest(span / (n + 0.5::DOUBLE), 100)), 6) AS width
    FROM (SELECT o_custkey, span, unnest(range(floor(span / 400 + 0.5::DOUBLE)::BIGINT, floor(span / 100 + 0.5::DOUBLE)::BIGINT + 1)) AS n FROM s)
    WHERE greatest(span / (n + 0.5::DOUBLE), 100) < least(CASE WHEN n = 0 THEN 400 ELSE span / (n - 0.5::DOUBLE) END, 400) GROUP BY 1""")
def alias_bands_of_spans(spark, sf_dir):
    """Bands of whole turns between 100 and 400 days over the span of each customer's orders."""
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double")
    spans = derived.table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.max(day) - F.min(day)).alias("span")).where("span > 0")
    bands = orbits.alias_bands_of(spans, "span", 100.0, 400.0)
    return bands.groupBy("o_custkey").agg(F.count("*").alias("bands"), F.round(F.sum(F.col("p_high") - F.col("p_low")), 6).alias("width"))


@query(f"""WITH {PIXELS}, side AS (SELECT {SIDE} AS n), b AS (SELECT image, value, pow(((n - 1) / 2.0::DOUBLE - col) * 40, 2) + pow(((n - 1) / 2.0::DOUBLE - row) * 40, 2) AS r2 FROM px, side)
    SELECT image, round(sum(value * exp(-4 * ln(2) * r2 / pow(1.13::DOUBLE * 299792458 / (230e9 * 12) / {MAS!r}::DOUBLE, 2))) / sum(value), 8) AS kept FROM b GROUP BY 1""")
def primary_beam_of_images(spark, sf_dir):
    """Share of every image's flux that a dish of 12 m at 230 GHz keeps."""
    px = derived.pixel_image(spark, sf_dir)
    half = (_side(px) - 1) / 2.0
    placed = px.withColumns({"dra": (half - F.col("col")) * 40.0, "ddec": (half - F.col("row")) * 40.0})
    lit = imaging.primary_beam(placed, 230e9, 12.0, 1.13)
    return lit.groupBy("image").agg(F.round(F.sum(F.col("value") * F.exp("log_beam")) / F.sum("value"), 8).alias("kept"))


# Files ---------------------------------------------------------------------------------------------------------------


@query(f"""WITH {SAMPLES}, b AS (SELECT sample_id, frame, station_a, station_b FROM ({BASELINES.removeprefix('baselines AS (').removesuffix(')')})),
    r AS (SELECT s.*, frame, station_a AS a, station_b AS b FROM samples s JOIN b USING (sample_id) WHERE event_type IN ('click', 'view'))
    SELECT event_type AS target, 'CH' || channel AS insname, count(*) AS n, round(sum(value), 6) AS v2, round(sum(error), 6) AS error, round(sum(u), 4) AS u, round(sum(mjd), 4) AS mjd, sum(a + 10 * b)::BIGINT AS stations,
        round(sum(sqrt(value)), 6) AS amp, round(sum(sin(value)), 6) AS phi FROM r GROUP BY 1, 2""")
def oifits_round_trip(spark, sf_dir):
    """All events as OIFITS files with squared visibilities, amplitudes and phases, read back for two targets, extras on their samples."""
    s = derived.samples(spark, sf_dir).join(derived.baselines(spark, sf_dir).drop("phi"), "sample_id")
    kind = lambda k, value: F.struct(F.lit(k).alias("kind"), value.alias("value"))
    v = F.col("value")
    none = F.lit(None).cast("double")
    rows = s.withColumn("k", F.explode(F.array(kind("v2", v), kind("amp", F.sqrt(v)), kind("phi", F.sin(v))))).select(
        F.concat(F.lit("part"), (F.col("user_id") % 16).cast("string")).alias("file"), "k.kind", F.concat(F.lit("CH"), F.col("channel").cast("string")).alias("insname"), F.col("sample_id").alias("row"), F.lit(0).alias("channel"), "wavel", (F.col("wavel") * 0.01).alias("bandwidth"),
        "mjd", F.col("sample_id").cast("double").alias("time"), F.lit(0.0).alias("exposure"), F.col("station_a").alias("sta1"), F.col("station_b").alias("sta2"), F.lit(-1).alias("sta3"), "u", "v", none.alias("u2"), none.alias("v2"), "k.value", "error", F.lit(False).alias("flag"), F.col("event_type").alias("target"),
    )
    path = f"{shared_dir(spark)}/oifits-{uuid.uuid4().hex}"
    oifits_source.write(rows, path).agg(F.sum("rows")).first()
    oifits_source.register(spark)
    long = spark.read.format("oifits").load(path).where("target in ('click', 'view')")
    extras = [oifits_source.aligned_extras(long, k).groupBy("sample_id").agg(F.max("value").alias(k)) for k in ("amp", "phi")]
    vis = oifits_source.sample_ids(long)
    for e in extras:
        vis = vis.join(e, "sample_id", "left")
    total = lambda x, d: F.round(F.sum(x), d)
    out = vis.groupBy("target", "insname").agg(
        F.count("*").alias("n"), total("value", 6).alias("v2"), total("error", 6).alias("error"), total("u", 4).alias("u"), total("mjd", 4).alias("mjd"), F.sum((F.col("sta1") + F.col("sta2") * 10).cast("long")).alias("stations"), total("amp", 6).alias("amp"), total("phi", 6).alias("phi"),
    )
    return out


# CLEAN ---------------------------------------------------------------------------------------------------------------


@query()
def restored_map(spark, sf_dir):
    """All visibilities cleaned in three rounds and seen by the beam of the main lobe, on 24 x 24 pixels."""
    points = derived.radio(spark, sf_dir).withColumn("imaging_weight", F.col("weight"))
    found = cleaning.clean(points, 24, 2.0, rounds=3, patch=8, tile=12)
    return rounded(found.restored(cleaning.Beam(4.0, 3.0, 20.0)), 6, "value")
