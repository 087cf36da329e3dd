"""Check rules on columns, and a stage runner that writes each stage and resumes after the last good one."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITY = ("pass", "warn", "fail")


def rule(value: Column, warn: float, fail: float) -> Column:
    """pass up to `warn`, warn up to `fail`, fail beyond, and for what is no number."""
    return F.when(value.isNull() | F.isnan(value), "fail").when(value <= warn, "pass").when(value <= fail, "warn").otherwise("fail")


def severity(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), status)


def worst(checks: DataFrame, by: list[str]) -> DataFrame:
    """The most severe status of each group."""
    return checks.groupBy(*by).agg(F.element_at(F.array(*map(F.lit, SEVERITY)), F.max(severity(F.col("status"))).cast("int")).alias("status"))


def grid_edge(index: Column, size: int) -> Column:
    """warn if the best index of an axis lies on its end."""
    return F.when((index <= 0) | (index >= size - 1), "warn").otherwise("pass")


def r_hat(draws: DataFrame, by: list[str]) -> DataFrame:
    """R-hat by site from per-chain moments of (chain, value); the draws are reduced by chain first."""
    c = draws.groupBy(*by, "chain").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    g = c.groupBy(*by).agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.avg("n").alias("n"))
    return g.select(*by, F.sqrt((F.col("w") * (F.col("n") - 1) / F.col("n") + F.col("b")) / F.col("w")).alias("r_hat"))


def fingerprint(df: DataFrame) -> DataFrame:
    """A content hash of a table that does not depend on row order: xor and sum of row hashes, and the count."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("sum"), F.count("*").alias("rows"))


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


def run_stages(spark: SparkSession, stages: list[Stage], output: str, settings: dict, resume: bool = True) -> dict[str, DataFrame]:
    """Run stages in order, each written as Parquet beside a record of its settings; with `resume`, good ones are read.

    A stage counts as done if its record names the same settings and the same stages before it. Tables and records go
    through Spark's file systems, so the output can be in any store that Spark reads.
    """
    done: dict[str, DataFrame] = {}
    key = hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()
    for s in stages:
        key = hashlib.sha256(f"{key}/{s.name}".encode()).hexdigest()
        at, record = f"{output}/{s.name}", f"{output}/{s.name}.record"
        if resume and _recorded(spark, record) == key:
            done[s.name] = spark.read.parquet(at)
            continue
        began = time.time()
        s.run(spark, done).write.mode("overwrite").parquet(at)
        row = [(s.name, "done", key, time.time() - began)]
        spark.createDataFrame(row, "name string, status string, key string, seconds double").coalesce(1).write.mode("overwrite").json(record)
        done[s.name] = spark.read.parquet(at)
    return done


def _recorded(spark: SparkSession, record: str) -> str | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(record)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    row = spark.read.schema("name string, status string, key string, seconds double").json(record).first()
    return row.key if row else None
