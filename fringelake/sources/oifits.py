"""OIFITS files as observation tables: files are read whole by Spark, each is parsed by one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.photometry import flagged
from ..operators import joins
from . import fits

ROW = "file string, kind string, insname string, row long, channel int, wavel double, bandwidth double, mjd double, time double, exposure double, sta1 int, sta2 int, sta3 int, u double, v double, u2 double, v2 double, value double, error double, flag boolean"
#: Kind -> (table, value, error, scale): phases are in degrees in files and in radians here.
KINDS = {"v2": ("OI_VIS2", "VIS2DATA", "VIS2ERR", 1.0), "amp": ("OI_VIS", "VISAMP", "VISAMPERR", 1.0), "phi": ("OI_VIS", "VISPHI", "VISPHIERR", np.pi / 180), "t3": ("OI_T3", "T3PHI", "T3PHIERR", np.pi / 180), "t3amp": ("OI_T3", "T3AMP", "T3AMPERR", 1.0), "flux": ("OI_FLUX", "FLUXDATA", "FLUXERR", 1.0)}
#: Days within which times count as one frame.
TOLERANCE = 1e-4


def long_rows(name: str, kind: str, t: fits.Table, wavelengths: list[fits.Table]) -> pd.DataFrame:
    """Every row and channel of one table, as one kind of observable."""
    _, value, error, scale = KINDS[kind]
    ins = str(t.header.get("INSNAME", "")).strip()
    wave, band = next((w.columns["EFF_WAVE"].astype(float), w.columns["EFF_BAND"].astype(float)) for w in wavelengths if str(w.header.get("INSNAME", "")).strip() == ins)
    c, n, k = t.columns, len(t.columns["MJD"]), len(wave)
    wide = lambda x: np.repeat(np.asarray(x), k)
    each = lambda x: np.asarray(x, float).reshape(n, k).ravel()
    sta = np.asarray(c["STA_INDEX"]).reshape(n, -1) if "STA_INDEX" in c else np.full((n, 3), -1)
    sta = np.pad(sta, ((0, 0), (0, 3 - sta.shape[1])), constant_values=-1)
    uv = lambda *names: wide(next((c[x] for x in names if x in c), np.full(n, np.nan)).astype(float))
    d = {"file": name, "kind": kind, "insname": ins, "row": wide(np.arange(n)), "channel": np.tile(np.arange(k), n), "wavel": np.tile(wave, n), "bandwidth": np.tile(band, n), "mjd": wide(c["MJD"]).astype(float), "time": wide(c.get("TIME", np.zeros(n))).astype(float), "exposure": wide(c.get("INT_TIME", np.zeros(n))).astype(float)}
    d |= {f"sta{i + 1}": wide(sta[:, i]).astype(np.int32) for i in range(3)} | {"u": uv("UCOORD", "U1COORD"), "v": uv("VCOORD", "V1COORD"), "u2": uv("U2COORD"), "v2": uv("V2COORD")}
    d |= {"value": each(c[value]) * scale, "error": each(c[error]) * scale, "flag": np.asarray(c.get("FLAG", np.zeros((n, k), bool)), bool).reshape(n, k).ravel()}
    return pd.DataFrame(d)


def rows_of(name: str, content: bytes, target: str | None = None, insname: str | None = None) -> pd.DataFrame:
    """Every row and channel of a file's observable tables, long."""
    tables = fits.read(content)
    targets = {int(i): str(n).strip() for t in tables if t.name == "OI_TARGET" for i, n in zip(t.columns["TARGET_ID"], t.columns["TARGET"])}
    waves = [t for t in tables if t.name == "OI_WAVELENGTH"]
    out = []
    for kind, (table, value, _, _) in KINDS.items():
        for t in tables:
            if t.name != table or value not in t.columns or (insname and str(t.header.get("INSNAME", "")).strip() != insname):
                continue
            pdf = long_rows(name, kind, t, waves)
            keep = np.array([target is None or targets.get(int(i)) == target for i in t.columns["TARGET_ID"]], bool)
            out.append(pdf[np.repeat(keep, len(pdf) // max(1, len(keep)))])
    names = [x.split()[0] for x in ROW.split(", ")]
    return pd.concat(out)[names] if out else pd.DataFrame(columns=names)


def read_long(spark: SparkSession, path: str, target: str | None = None, insname: str | None = None) -> DataFrame:
    """The rows of all OIFITS files at a path, in one row per table row and channel."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                yield rows_of(name, content, target, insname)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, ROW)


def observation(long: DataFrame) -> dict[str, DataFrame]:
    """samples, vis and triangles of long rows, linked by sample_id; squared visibilities are preferred to amplitudes.

    A triangle's legs are matched to the visibility rows of the same file, instrument, channel and station pair,
    whichever way round, that are nearest in time; a leg without one makes a flagged sample of its own.
    """
    has = long.where("kind = 'v2'").select("file", "insname").distinct().withColumn("has_v2", F.lit(True))
    vis = long.where("kind in ('v2', 'amp')").join(has, ["file", "insname"], "left").where("kind = 'v2' or has_v2 is null").drop("has_v2")
    key = [F.least("sta1", "sta2").alias("a"), F.greatest("sta1", "sta2").alias("b")]
    vis = vis.select("*", *key, F.xxhash64("file", "insname", "row", "channel", F.lit("vis")).alias("sample_id"))
    t3 = long.where("kind = 't3'").withColumn("tri_id", F.xxhash64("file", "insname", "row", "channel", F.lit("t3")))
    leg = lambda n, p, q, u, v: F.struct(F.lit(n).alias("leg"), F.col(p).alias("p"), F.col(q).alias("q"), u.alias("lu"), v.alias("lv"))
    u1, v1, u2, v2 = map(F.col, ("u", "v", "u2", "v2"))
    legs = t3.select("tri_id", "file", "insname", "channel", "wavel", "bandwidth", "mjd", F.explode(F.array(leg(1, "sta1", "sta2", u1, v1), leg(2, "sta2", "sta3", u2, v2), leg(3, "sta1", "sta3", u1 + u2, v1 + v2))).alias("x"))
    legs = legs.select("tri_id", "file", "insname", "channel", "wavel", "bandwidth", "mjd", "x.*").withColumns({"a": F.least("p", "q"), "b": F.greatest("p", "q"), "left_id": F.xxhash64("tri_id", "leg")})
    keys = ["file", "insname", "channel", "a", "b"]
    found = joins.nearest(legs.withColumnRenamed("mjd", "lt"), vis.select(*keys, F.col("mjd").alias("rt"), "sample_id"), keys, "lt", "rt", TOLERANCE, "sample_id")
    made = found.where("sample_id is null").withColumn("sample_id", F.col("left_id"))
    linked = found.where("sample_id is not null").select("tri_id", "leg", "sample_id").unionByName(made.select("tri_id", "leg", "sample_id"))
    samples = vis.select("file", "sample_id", "u", "v", "wavel", "bandwidth", "mjd", F.col("sta1").alias("station_a"), F.col("sta2").alias("station_b"))
    samples = samples.unionByName(made.select("file", "sample_id", F.col("lu").alias("u"), F.col("lv").alias("v"), "wavel", "bandwidth", F.col("lt").alias("mjd"), F.col("p").alias("station_a"), F.col("q").alias("station_b")))
    pick = lambda n: F.max(F.when(F.col("leg") == n, F.col("sample_id"))).alias(f"s{n}")
    triangles = linked.groupBy("tri_id").agg(pick(1), pick(2), pick(3)).join(t3.select("tri_id", "file", F.col("value").alias("phi"), F.col("error").alias("d_phi"), flagged(F.col("value"), F.col("error"), F.col("flag")).alias("flag")), "tri_id")
    return {"samples": samples, "vis": vis.select("file", "sample_id", "kind", "value", "error", flagged(F.col("value"), F.col("error"), F.col("flag")).alias("flag")), "triangles": triangles}


def build(wave: np.ndarray, band: np.ndarray, vis2: dict[str, np.ndarray], t3: dict[str, np.ndarray] | None = None, target: str = "TARGET", insname: str = "INS") -> bytes:
    """An OIFITS file of squared visibilities (mjd, u, v, sta, value, error) and closure phases in radians."""
    head = {"OI_REVN": 2, "ARRNAME": "ARRAY", "INSNAME": insname, "DATE-OBS": "2024-01-01"}
    one = lambda n, x: np.full(n, x, np.int16)
    n, k = len(vis2["mjd"]), len(wave)
    shape = lambda x, m: np.asarray(x, float).reshape(m, k)
    tables = [
        fits.Table("OI_TARGET", {"OI_REVN": 2}, {"TARGET_ID": one(1, 1), "TARGET": np.array([target], object)}),
        fits.Table("OI_WAVELENGTH", head, {"EFF_WAVE": np.asarray(wave, np.float32), "EFF_BAND": np.asarray(band, np.float32)}),
        fits.Table("OI_VIS2", head, {"TARGET_ID": one(n, 1), "TIME": np.zeros(n), "MJD": np.asarray(vis2["mjd"], float), "INT_TIME": np.full(n, 1.0), "VIS2DATA": shape(vis2["value"], n), "VIS2ERR": shape(vis2["error"], n), "UCOORD": np.asarray(vis2["u"], float), "VCOORD": np.asarray(vis2["v"], float), "STA_INDEX": np.asarray(vis2["sta"], np.int16), "FLAG": np.zeros((n, k), bool)}),
    ]
    if t3 is not None:
        m, deg = len(t3["mjd"]), 180 / np.pi
        c = {"TARGET_ID": one(m, 1), "TIME": np.zeros(m), "MJD": np.asarray(t3["mjd"], float), "INT_TIME": np.full(m, 1.0), "T3AMP": np.ones((m, k)), "T3AMPERR": np.ones((m, k)), "T3PHI": shape(t3["value"], m) * deg, "T3PHIERR": shape(t3["error"], m) * deg}
        c |= {f"{x}{i}COORD": np.asarray(t3[f"{x.lower()}{i}"], float) for i in (1, 2) for x in ("U", "V")} | {"STA_INDEX": np.asarray(t3["sta"], np.int16), "FLAG": np.zeros((m, k), bool)}
        tables.append(fits.Table("OI_T3", head, c))
    return fits.write(tables)
