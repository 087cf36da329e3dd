"""The corpus pipeline: five stages, each a table of documents made from the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fringelake.llm import bpe, langid, line_dedup, mixing, near_copies
from fringelake.llm.queries import vocabulary
from fringelake.llm.shared import WORD, materialize, release, remainder, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Languages less sure than this are taken as not identified.
SURE = 0.5
#: Ids that go are broadcast up to so many, some tens of MB.
FEW = 2_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified (not `und`, score SURE or more) stay, each row judged by itself.

    Null and empty texts, and those without a letter, are `und` and go; very long ones are read whole. Repeated rows,
    ties and null ids are judged alike; an empty table stays empty; columns beside those of documents go.
    """
    small_batches(spark)
    found = langid.with_language(docs.select(*COLUMNS), remainder("doc_id", 3) == 1)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts, and n_chars follows; documents of which nothing is left go.

    Null texts, and texts that lose nothing, stay as they are, empty ones too; ties and repeated rows are settled as
    `line_dedup` says; an empty table stays empty.
    """
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    left = (F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(left).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (word shingles of five words, similarity 0.8 or more) the smallest id stays.

    Rows of one doc_id, or without one, are one document, which stays if any of its rows is to stay. Ids that go are
    broadcast if counted to be at most FEW, and joined by a shuffle beyond.
    """
    small_batches(spark)
    found = near_copies.near_copies(docs, words=5, similarity=0.8)
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = materialize(found.groupBy(F.col("doc_id").alias("__id")).agg(stays.alias("stays")).where("not stays").select("__id"), "gone")
    side = F.broadcast(gone) if gone.count() <= FEW else gone
    return docs.join(side, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not, once or twice.

    Rows equal in doc_id, source and size, nulls too, share the copies taken of them; where these do not come out
    even, the first rows by a hash of the text have one more.
    """
    took = mixing.mix(docs).where("size > 0").groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"))
    took = materialize(took.agg(F.count("*").alias("__rows"), F.sum(F.round(F.col("taken") / F.col("size"))).cast("long").alias("__copies")).where("__copies > 0"), "took")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__own") == F.col("__size"))
    rows = docs.select(*COLUMNS, size.alias("__own")).join(took, same)  # a column, as the sort of the join would count words at each comparison
    copies = F.floor(F.col("__copies") / F.col("__rows"))
    if not took.where("__copies % __rows != 0").isEmpty():
        place = F.row_number().over(Window.partitionBy("__id", "__source", "__size").orderBy(F.xxhash64("text")))
        rows = rows.withColumn("__place", place)
        copies += F.when(F.col("__place") <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
    return rows.select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("__copy")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix; null counts as empty, an empty table gives no rows."""
    small_batches(spark)
    return bpe.encode(docs, vocabulary())


STAGES = [("language_id", language_id), ("line_dedup", without_repeated_lines), ("simhash", without_near_duplicates), ("mixing", mixed), ("bpe", encoded)]

#: Learned and iterated stages are beyond SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next; what it was made from then goes.

    Nulls, empty and very long texts, ties, repeated rows and extra columns are as each stage defines them; an empty
    table gives no rows. The session's limits of an Arrow batch are lowered to `shared.BATCH` and stay so.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return docs
