"""Incremental additions: sessions of samples by gap, and detection counts over arriving draws.

Batch sessionising is in operators.joins; these are Structured Streaming forms of the same rule, which the batch query
catalogue is tested against. They are additions to it, not counterparts of anything streamed elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_epochs(events: DataFrame, key: str, ts: str, gap: str, delay: str | None = None) -> DataFrame:
    """Sessions whose events lie `gap` or less apart, closed once the watermark (by default one gap) has passed."""
    return events.withWatermark(ts, delay or gap).groupBy(key, F.session_window(ts, gap).alias("session")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).select(key, "first", "last", "n")


def exceedances(draws: DataFrame, stat: str, value: float) -> DataFrame:
    """Running false-alarm counts of draws that arrive in files; independent of how they are cut into batches."""
    return draws.groupBy().agg(F.sum((F.col(stat) >= value).cast("long")).alias("k"), F.count("*").alias("n")).select("k", "n", ((F.col("k") + 1) / (F.col("n") + 1)).alias("fap"))


def fold_scores(records: DataFrame) -> DataFrame:
    """Mean score per setting over fold records that arrive as files."""
    return records.groupBy("setting").agg(F.avg("score").alias("mean"), F.count("*").alias("folds"))
