"""What the operators of this subpackage share: tables in the shared folder, hashes, components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The characters that part words, as a Java and DuckDB class; bytes.split() parts at the same six.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Rows and bytes of a batch that goes to Python, in a session that small_batches() was called for.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}

#: What this worker process keeps for its next task, by name.
_kept: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can see, from spark.checkpoint.dir.

    Where that is unset and the session is local (tests), a temporary folder is made once. On a cluster an unset
    folder is an error, as a machine-local one would be seen by one executor alone.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="fringelake-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    atexit.register(__import__("shutil").rmtree, made, True)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write `df` to the shared folder, in folders `by` columns, and read it back.

    Its lineage ends there, so a lost executor costs no rerun.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out._fringelake_path = path
    return out


def counted(df: DataFrame, tag: str, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
    """materialize(), with the number of `rows` and aggregates `sums` of what was written, taken along in the same job."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.coalesce(x, F.lit(0)).alias(k) for k, x in sums.items())), tag)
    return out, seen.get


def release(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that no result reads any more."""
    path = getattr(df, "_fringelake_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits of an Arrow batch to BATCH, where they aren't lower.

    By Spark's own, a task's texts are one batch of tens of MB, held several times over by the JVM and the worker. The
    limits stay, as a stage's plan is made when its result is written.
    """
    for key, most in BATCH.items():
        now = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def kept(name: str, make: Callable[[], object]) -> object:
    """make(), kept by this worker process for its next tasks, until one of returning_memory() keeps another name."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def forget(but: str = "") -> None:
    """Drop what kept() holds under other names."""
    for name in _kept.keys() - {but}:
        del _kept[name]


def give_back() -> None:
    """Give freed memory of Arrow's pool and the C library back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def returning_memory(run: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """An Arrow function that gives what its batches took back to the system at the end of a task.

    Workers live on between tasks and stages, and Arrow's pool and the C library keep freed memory for them, some 250 MB
    after batches of long texts. What another stage's tasks left with kept() goes first, unless it is named `keeps`.
    """

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        forget(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of `edges` (u, v), by alternating stars.

    Large-star hangs every larger neighbour on a node's smallest neighbour, small-star the smaller ones; both are a
    grouped minimum (combined before the shuffle) and an equi-join whose hot side adaptive execution can split, so a
    hub with a third of all links stays spread. Each round is written to the shared folder and the last one dropped.
    The minima of a round tell, without a round more, that all edges are stars: every node is then smaller than its
    neighbours or has one neighbour alone.
    """
    now = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    now = materialize(now, "edges")
    while True:
        both = now.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("m")), F.struct(F.col("b").alias("n"), F.col("a").alias("m")))).alias("e")).select("e.*")
        least = both.groupBy("n").agg(F.min("m").alias("low"), F.count("*").alias("many")).select("n", F.least("n", "low").alias("low"), ((F.col("low") < F.col("n")) & (F.col("many") > 1)).alias("open"))
        least, seen = counted(least, "least", open=F.count_if("open"))
        if not seen["open"]:
            release(now)
            return least.select(F.col("n").alias("node"), F.col("low").alias("root"))
        large = both.join(least.select("n", "low"), "n").where("m > n").select(F.col("m").alias("a"), F.col("low").alias("b")).distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lows, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        after = materialize(small.where("a != b").distinct(), "edges")
        release(now)
        release(least)
        now = after
