"""Tables of results on disk: one JSON record per task, and detection runs as Parquet with their settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CV = "setting double, fold int, score double, chi2 double, n_test long, n_train long, loss double, converged boolean, steps long, stop string"


def save_records(records: DataFrame, path: str) -> None:
    """NaN and infinities become null, as JSON has none."""
    clean = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in records.dtypes]
    records.select(*clean).write.mode("append").json(path)


def load_records(spark: SparkSession, path: str, schema: str = CV) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_run(table: DataFrame, path: str, settings: dict) -> None:
    """A run's rows, each with the run's settings as JSON, so that runs can be told apart after they are joined."""
    table.withColumn("settings", F.lit(json.dumps(settings, sort_keys=True))).write.mode("overwrite").parquet(path)


def concatenate(runs: list[DataFrame]) -> DataFrame:
    """Runs of one experiment end to end; draws are numbered on, and differing settings are refused."""
    out = None
    settings: set[str] = set()
    for i, r in enumerate(runs):
        settings |= {x.settings for x in r.select("settings").distinct().limit(2).collect()}
        part = r.withColumn("run", F.lit(i))
        out = part if out is None else out.unionByName(part)
    if len(settings) > 1:
        raise ValueError("runs of different experiments")
    return out
