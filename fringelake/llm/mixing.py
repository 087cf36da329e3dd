"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, materialize

#: Rows that one window of the cumulative sums holds on average.
ROWS = 4096
#: At most so many bins of virtual time are summed to find the cut.
MOST_BINS = 8192


def with_targets(sources: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """Add (weight, target) to one row per source (source, source_size).

    Sources ordered by code point, null last, take the weights in turn. A level L is sought so that
    sum(min(repeats * size, L * weight)) is the budget: filling stops at `repeats` times a source's size and the rest
    is shared anew by weight. The sources' number bounds the one-partition window, not the documents'.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    out = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    out = out.withColumn("cap", F.col("source_size") * F.lit(repeats)).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    rank = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, onward = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = out.withColumn("budget", F.lit(share) * F.sum("source_size").over(every))
    out = out.withColumn("level_here", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
    fits = F.when(F.col("level_here") <= F.col("ratio"), F.struct("ratio", "level_here"))
    out = out.withColumn("level", F.min(fits).over(every)["level_here"])
    return out.withColumn("target", F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, virtual_finish, source.

    Documents are shuffled by md5 of the id. Copy e of a document finishes at virtual time
    (e * source_size + words of its source up to and with it) / target of its source. All copies in the order of that
    time are taken until the budget, the sum of targets, is full; `taken` is the words of a document's copies taken,
    `virtual_finish` the time of its first copy.

    Running sums go over slices of each source's shuffled order: slice totals are combined before the shuffle and
    summed up on the small table, so that a source with a third of all rows is no one task. The cut is found from the
    words per bin of virtual time, and exactly in the one bin that holds it.

    Null text is size 0; size 0, empty tables and sources without words take 0. A null source is a source of its own,
    a null doc_id shuffles as an empty string. Repeated rows are copies in their own right. Other columns are ignored.
    """
    key = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"))
    base = materialize(base, "mix")
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = materialize(with_targets(sums.select("source", "source_size"), weights, share, repeats), "targets")
    most = sums.agg(F.max("n")).first()[0] or 0
    slices = max(1, math.ceil(most / ROWS))

    named = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("named")
    piece = F.floor(F.coalesce(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(0)) * slices / 2.0**32).cast("long")
    rows = base.select("doc_id", named, "size", "key", piece.alias("piece"))
    up_to = Window.partitionBy("named").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy("named", "piece").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0))).drop("words")
    heads = heads.join(targets.select(named, "source_size", "target"), "named")
    within = Window.partitionBy("named", "piece").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(heads, ["named", "piece"]).withColumn("upto", F.col("before") + F.sum("size").over(within))
    finish = [F.when(F.col("target") > 0, (F.col("upto") + F.col("source_size") * e) / F.col("target")) for e in range(repeats)]
    rows = materialize(rows.select("doc_id", "named", "key", "size", "source_size", "target", *(f.alias(f"f{e}") for e, f in enumerate(finish))), "mix")

    total = targets.agg(F.sum("target"), F.count("*")).first()
    copies = rows.where("size > 0").select("doc_id", "named", "key", "size", F.explode(F.array(*(F.struct(F.col(f"f{e}").alias("finish"), F.lit(e).alias("e")) for e in range(repeats)))).alias("c"))
    copies = copies.select("doc_id", "named", "key", "size", "c.finish", "c.e").where("finish is not null")
    bins = max(1, min(MOST_BINS, math.ceil(repeats * rows.count() / ROWS)))
    at = F.least(F.floor(F.col("finish") * bins), F.lit(2 * bins)).cast("int")
    left, cut_bin = float(total[0] or 0), None
    for b, words in sorted(map(tuple, copies.groupBy(at.alias("b")).agg(F.sum("size")).collect())):
        cut_bin = b
        if words > left:
            break
        left -= words
    else:
        cut_bin = None
    order = ["finish", "named", "key", "doc_id", "e"]
    if cut_bin is None:
        took = [F.col(f"f{e}").isNotNull() for e in range(repeats)]
    else:
        ranked = copies.where(at == cut_bin).withColumn("sum", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        last = ranked.where(F.col("sum") <= left).agg(F.max(F.struct(*order)).alias("x")).first()[0]
        if last is None:
            took = [F.floor(F.col(f"f{e}") * bins) < cut_bin for e in range(repeats)]
        else:
            end = F.struct(*(F.lit(last[c]).cast(dict(copies.dtypes)[c]).alias(c) for c in order))
            took = [F.struct(F.col(f"f{e}").alias("finish"), "named", "key", "doc_id", F.lit(e).alias("e")) <= end for e in range(repeats)]
    taken = sum((F.when(t & F.col(f"f{e}").isNotNull(), F.col("size")).otherwise(F.lit(0)) for e, t in enumerate(took)), F.lit(0))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("f0").alias("virtual_finish"), F.when(F.col("named") != "n", F.expr("substring(named, 2)")).alias("source"))
