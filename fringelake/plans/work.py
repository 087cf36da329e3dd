"""Work tables: what an iteration hands on to its next round, written where every executor can read it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on a local master without it a temporary one, on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="fringelake-work-")
        atexit.register(__import__("shutil").rmtree, made, True)
        spark.sparkContext.setCheckpointDir(f"file://{made}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Table:
    """A written table that can be dropped once its successor is there."""

    def __init__(self, df: DataFrame, tag: str = "work"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
