"""Generated observations: earth-rotation tracks, aperture masks and scenes predicted on a template."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.photometry import observable
from ..operators.detection import normal
from ..plans.models import Component, Uv

# The four large telescopes' positions east and north in metres.
UTS = ((-9.925, -20.335), (14.887, 30.502), (44.915, 66.183), (103.306, 43.999))
# Fixed value: the site's geodetic latitude in degrees.
LATITUDE = -24.6276


def tracks(spark: SparkSession, stations=UTS, declination: float = -50.0, hour_angles=(-3.0, -1.5, 0.0, 1.5, 3.0), wavelengths=(2.0e-6, 2.2e-6, 2.4e-6), latitude: float = LATITUDE) -> DataFrame:
    """samples of every station pair, hour angle and channel: theta self-join of stations, crossed with the axes."""
    st = spark.createDataFrame([(i, float(e), float(n)) for i, (e, n) in enumerate(stations)], "station int, e double, n double")
    a, b = (st.select(*(F.col(c).alias(f"{c}_{x}") for c in st.columns)) for x in "ab")
    axes = spark.range(1).select(F.posexplode(F.array(*map(F.lit, map(float, hour_angles)))).alias("frame", "ha")).select("*", F.posexplode(F.array(*map(F.lit, map(float, wavelengths)))).alias("channel", "wavel"))
    east, north = F.col("e_b") - F.col("e_a"), F.col("n_b") - F.col("n_a")
    lat, dec, h = math.radians(latitude), math.radians(declination), F.radians(F.col("ha") * 15.0)
    x, y, z = north * -math.sin(lat), east, north * math.cos(lat)
    u = F.sin(h) * x + F.cos(h) * y
    v = F.cos(h) * x * -math.sin(dec) + F.sin(h) * y * math.sin(dec) + z * math.cos(dec)
    out = a.join(b, F.col("station_a") < F.col("station_b")).crossJoin(F.broadcast(axes))
    key = ((F.col("frame").cast("long") * 1000 + F.col("station_a")) * 1000 + F.col("station_b")) * 1000 + F.col("channel")
    return out.select(key.cast("long").alias("sample_id"), "frame", "channel", "station_a", "station_b", u.alias("u"), v.alias("v"), "wavel", (F.col("ha") / 24.0).alias("mjd"))


def mask_samples(spark: SparkSession, holes, wavelength: float = 4.3e-6, rotation: float = 0.0) -> DataFrame:
    """samples of every pair of holes (x, y in metres) of an aperture mask, turned by an angle in degrees."""
    a = math.radians(rotation)
    turned = [(x * math.cos(a) + y * math.sin(a), y * math.cos(a) - x * math.sin(a)) for x, y in holes]
    return tracks(spark, turned, 90.0, (0.0,), (wavelength,), 90.0)


def simulate(samples: DataFrame, scene: Component, kind: str = "v2", sigma: float = 0.01, seed: int = 0, noise: float = 1.0) -> DataFrame:
    """vis(sample_id, value, error): a scene on a template's sampling, with noise drawn by (seed, sample)."""
    s = Uv(F.col("u") / F.col("wavel"), F.col("v") / F.col("wavel"), F.col("wavel"))
    value = observable(scene.cvis(s), kind) + normal(F.lit(seed), "sample_id") * (sigma * noise)
    return samples.select("sample_id", value.alias("value"), F.lit(sigma).alias("error"))
