"""One place that builds a session with the settings the engine assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on; `conf` overrides single settings."""
    builder = SparkSession.builder.appName("fringelake")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
