"""Observation tables derived from the driver's star schema, each as a DataFrame and as SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(ts: str = "ts", since: str = "2024-01-01") -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(F.col(ts)) - micros(F.lit(f"{since} 00:00:00"))).cast("double") / 86400000000.0


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: baseline in metres, wavelength, time, squared visibility and its error."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("sample_id"), "user_id", "event_type", days().alias("mjd"), (F.col("event_id") % 5).cast("int").alias("channel"), ((F.col("event_id") % 5) * 0.1 + 3.0) * F.lit(1e-6),
        (F.cos((F.col("user_id") % 17) * 0.37) * 60.0).alias("u"), (F.sin((F.col("user_id") % 13) * 0.53) * 60.0).alias("v"), (1.0 / (F.col("value") / 500.0 + 1.0)).alias("value"), ((F.col("event_id") % 3) * 0.01 + 0.05).alias("error"),
    ).toDF("sample_id", "user_id", "event_type", "mjd", "channel", "wavel", "u", "v", "value", "error")


SAMPLES = """samples AS (SELECT event_id AS sample_id, user_id, event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))::DOUBLE / 86400000000.0::DOUBLE AS mjd,
    (event_id % 5)::INT AS channel, ((event_id % 5) * 0.1::DOUBLE + 3.0::DOUBLE) * 1e-6::DOUBLE AS wavel, cos((user_id % 17) * 0.37::DOUBLE) * 60.0::DOUBLE AS u,
    sin((user_id % 13) * 0.53::DOUBLE) * 60.0::DOUBLE AS v, 1.0::DOUBLE / (value / 500.0::DOUBLE + 1.0::DOUBLE) AS value, (event_id % 3) * 0.01::DOUBLE + 0.05::DOUBLE AS error FROM events)"""


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six events make a frame of four stations; each event is one baseline with a phase."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 6
    a = F.when(k < 3, 0).when(k < 5, 1).otherwise(2)
    b = F.when(k < 3, k + 1).when(k < 5, k - 1).otherwise(3)
    return e.select(F.col("event_id").alias("sample_id"), F.floor(F.col("event_id") / 6).alias("frame"), a.cast("int").alias("station_a"), b.cast("int").alias("station_b"), (F.col("value") * 0.01).alias("phi"))


BASELINES = """baselines AS (SELECT event_id AS sample_id, event_id // 6 AS frame, CASE WHEN event_id % 6 < 3 THEN 0 WHEN event_id % 6 < 5 THEN 1 ELSE 2 END AS station_a,
    CASE WHEN event_id % 6 < 3 THEN event_id % 6 + 1 WHEN event_id % 6 < 5 THEN event_id % 6 - 1 ELSE 3 END AS station_b, value * 0.01::DOUBLE AS phi FROM events)"""


def radio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: a complex visibility on a baseline in wavelengths."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("point_id"), (F.cos(F.col("user_id") * 0.11) * 4e6).alias("u"), (F.sin(F.col("user_id") * 0.07) * 4e6).alias("v"), (F.col("value") / 100.0).alias("re"), (F.col("value") / 200.0 - 0.1).alias("im"),
        ((F.col("event_id") % 4) * 0.5 + 1.0).alias("weight"), (F.col("user_id") % 3).cast("int").alias("ddid"), (F.col("user_id") % 2).cast("int").alias("obs"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time"),
        (F.col("user_id") % 5).cast("int").alias("ant1"), (F.col("user_id") % 7 + 5).cast("int").alias("ant2"), F.lit(1.0e9).alias("freq"), F.lit(0).alias("scan"),
    )


RADIO = """radio AS (SELECT event_id AS point_id, cos(user_id * 0.11::DOUBLE) * 4e6::DOUBLE AS u, sin(user_id * 0.07::DOUBLE) * 4e6::DOUBLE AS v, value / 100.0::DOUBLE AS re, value / 200.0::DOUBLE - 0.1::DOUBLE AS im,
    (event_id % 4) * 0.5::DOUBLE + 1.0::DOUBLE AS weight, (user_id % 3)::INT AS ddid, (user_id % 2)::INT AS obs, epoch_us(ts) AS time, (user_id % 5)::INT AS ant1, (user_id % 7 + 5)::INT AS ant2, 1.0e9::DOUBLE AS freq, 0 AS scan FROM events)"""


def pixel_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images 20 pixels wide, by brand: the price is the brightness."""
    p = table(spark, sf_dir, "part")
    k = F.floor(F.col("p_partkey") / 10)
    return p.select((F.col("p_partkey") % 10).alias("image"), F.floor(k / 20).cast("int").alias("row"), (k % 20).cast("int").alias("col"), (F.col("p_retailprice") / 1000.0).alias("value"), ((F.col("p_size") + 1) / 25.0).alias("truth"))


PIXELS = """px AS (SELECT p_partkey % 10 AS image, (p_partkey // 10 // 20)::INT AS row, (p_partkey // 10 % 20)::INT AS col, p_retailprice / 1000.0::DOUBLE AS value, (p_size + 1) / 25.0::DOUBLE AS truth FROM part)"""


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by date as astrometric epochs: some 2,400 nights at any scale, with mas offsets."""
    o = table(spark, sf_dir, "orders")
    t = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double")
    return o.groupBy(t.alias("mjd")).agg(F.round(F.avg("o_totalprice") / 20000.0 - 4.0, 6).alias("dra"), F.round(F.avg("o_custkey") / 100.0 - 4.0, 6).alias("ddec"), F.lit(0.05).alias("sigma"))


EPOCHS = """ep AS (SELECT date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS mjd, round(avg(o_totalprice) / 20000.0::DOUBLE - 4.0::DOUBLE, 6) AS dra,
    round(avg(o_custkey) / 100.0::DOUBLE - 4.0::DOUBLE, 6) AS ddec, 0.05::DOUBLE AS sigma FROM orders GROUP BY 1)"""
