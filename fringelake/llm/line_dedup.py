"""Line dedup by a deletion-neighbourhood join, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, materialize, release

#: Blocks of a line of which candidates share all but one.
BLOCKS = 8
#: Candidate lines that are broadcast to their texts at most, some 16 MB, and numbers of lines that go, about as large.
BROADCAST, FEW = 400_000, 2_000_000


def _words(line: Column) -> Column:
    return F.split(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), f"[{SPACE}]+")


def _within_one(a: Column, b: Column) -> Column:
    """Whether one word inserted, deleted or replaced turns array a into b."""

    def same(x, y):
        at = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(at == 0, F.greatest(F.size(x), F.size(y))).otherwise(at - 1)

    return (F.abs(F.size(a) - F.size(b)) <= 1) & (same(a, b) + same(F.reverse(a), F.reverse(b)) >= F.greatest(F.size(a), F.size(b)) - 1)


def _half(n: Column) -> Column:
    """Words at each end of a line that are hashed: at most half of them, and mostly the same for n and n - 1."""
    return F.when(n < 32, F.floor(n / 2)).otherwise(F.floor(n / 16) * 8).cast("int")


def _span(short: Column, i) -> tuple[Column, Column, Column]:
    """(head, tail, block): words before and after block i of a line and, for a line of `short` words, within it."""
    k = F.ceil(short / BLOCKS).cast("int")
    head, tail = F.least(k * i, short), F.greatest(short - k * (i + 1), F.lit(0))
    return head, tail, short - head - tail


def _but_one_block(words: Column) -> Column:
    """(rest, i, longer): hashes of a line without each of BLOCKS even blocks, as shorter and as longer line of a pair.

    Blocks are cut by the shorter line's length, so that lines that differ by one edit in block i agree on the words
    before and after it.
    """
    n = F.size(words)

    def key(longer: bool, i: int) -> Column:
        short = n - int(longer)
        head, tail, _ = _span(short, i)
        return F.struct(F.xxhash64(short, F.lit(i), F.slice(words, F.lit(1), head), F.slice(words, n - tail + 1, tail)).alias("rest"), F.lit(i).alias("i"), F.lit(longer).alias("longer"))

    return F.array(*(key(longer, i) for longer in (False, True) for i in range(BLOCKS)))


def _bounded(side: DataFrame, rows: int, most: int) -> DataFrame:
    """The side of a join that is broadcast if its counted rows are at most `most`, and else shuffled."""
    return F.broadcast(side) if rows <= most else side


def near_lines(known: DataFrame, docs: DataFrame, near_words: int) -> DataFrame:
    """Seals of lines of `known` that have an earlier line within one word edit.

    An edit leaves the first or the last words of the shorter line, up to half of it, as they were, so only lines that
    share such a half with another can match; of these, only lines that share all but one of BLOCKS blocks. What is
    left emits the deletion neighbourhood of that block, keyed with the hash of the rest: the block without its j-th
    word as (j, hash), equal for lines that differ in that word, and as (hash), equal to the whole block of a line that
    lacks it. Lines meet only the earliest line of a variant, never each other; what is found is verified on the words.
    """
    half = lambda end, m, h: F.when(F.col(h).isNotNull(), F.xxhash64(F.lit(end), F.col(m), F.col(h)))
    keys = F.array_compact(F.array(half("p", "m0", "p0"), half("s", "m0", "s0"), half("p", "m1", "p1"), half("s", "m1", "s1")))
    halves = known.select("seal", F.explode(keys).alias("half"))
    shared = halves.groupBy("half").count().where("count > 1").select("half")
    maybe = materialize(halves.join(shared, "half").select("seal").distinct(), "maybe")
    many = maybe.count()

    asked = known.select("seal", "first").join(_bounded(maybe, many, BROADCAST), "seal").groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.told").alias("told")).agg(F.collect_list(F.struct("first.line", "seal")).alias("asked"))
    told = docs.join(_bounded(asked, many, BROADCAST), ["doc_id", "told"]).select("doc_id", "told", F.split("text", "\n").alias("lines"), F.explode("asked").alias("q"))
    told = told.select(F.col("q.seal").alias("seal"), F.struct("doc_id", "told", F.col("q.line").alias("line")).alias("at"), _words(F.col("lines")[F.col("q.line")]).alias("words"))
    told = materialize(told.dropDuplicates(["seal"]), "told")

    blocks = materialize(told.select("seal", F.explode(_but_one_block(F.col("words"))).alias("b")).select("seal", "b.*"), "blocks")
    twice = blocks.groupBy("rest").count().where("count > 1").select("rest")
    held = materialize(blocks.join(twice, "rest"), "held")
    release(blocks)
    n = F.size("words")
    head, _, size = _span(n - F.col("longer").cast("int"), F.col("i"))
    held = held.join(told, "seal").select("seal", "at", "rest", "longer", F.slice("words", head + 1, size + F.col("longer").cast("int")).alias("block"))
    without = lambda j: (F.slice("block", F.lit(1), j), F.slice("block", j + 2, F.size("block")))
    variant = lambda role, *parts: F.struct(F.lit(role).alias("role"), F.xxhash64("rest", F.lit(role == "replaced"), *parts).alias("x"), F.xxhash64(F.lit(1), "rest", *parts).alias("y"))
    places = F.when(F.size("block") > 0, F.sequence(F.lit(0), F.size("block") - 1)).otherwise(F.array().cast("array<int>"))
    replaced = F.transform(places, lambda j: variant("replaced", j, *without(j)))
    shortened = F.transform(places, lambda j: variant("shortened", F.size("block") - 1, F.concat(*without(j))))
    emitted = F.when(F.col("longer"), shortened).otherwise(F.concat(replaced, F.array(variant("whole", F.size("block"), F.col("block")))))
    variants = held.select("seal", "at", F.explode(emitted).alias("v")).select("seal", "at", "v.*")
    firsts = variants.groupBy("x", "y").agg(
        F.count("*").alias("many"), F.min(F.when(F.col("role") == "whole", F.struct("at", "seal"))).alias("whole"), F.min(F.when(F.col("role") != "whole", F.struct("at", "seal"))).alias("part")
    ).where("many > 1")
    earlier = F.when(F.col("role") == "shortened", F.col("whole")).otherwise(F.col("part"))
    links = variants.join(firsts, ["x", "y"]).withColumn("to", earlier).where(F.col("to.at") < F.col("at")).select("seal", F.col("to.seal").alias("to")).distinct()
    a, b = told.select("seal", F.col("words").alias("a")), told.select(F.col("seal").alias("to"), F.col("words").alias("b"))
    return links.join(a, "seal").join(b, "to").where(_within_one(F.col("a"), F.col("b"))).select("seal").distinct()


def dropped_lines(docs: DataFrame, least_words: int = 5, near_words: int = 10) -> DataFrame:
    """(doc_id, told, lines): the numbers, from 0, of the lines that go from each text (by its hash `told`) that loses any."""
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("told"), "text")
    lines = docs.select("doc_id", "told", F.posexplode(F.split("text", "\n")).alias("line", "w")).where(F.btrim("w", F.lit(" \t\n\x0b\x0c\r")) != "").select("doc_id", "told", "line", _words(F.col("w")).alias("w"))
    n = F.size("w")
    m0, m1 = _half(n), _half(n - 1)
    ends = lambda m, yes: (F.when(yes, F.xxhash64(F.slice("w", F.lit(1), m))), F.when(yes, F.xxhash64(F.slice("w", n - m + 1, m))))
    (p0, s0), (p1, s1) = ends(m0, n >= near_words), ends(m1, (n >= near_words) & (m1 != m0))
    if least_words > 1:  # the filter would part each line once more
        lines = lines.where(n >= least_words)
    lines = lines.select("doc_id", "told", "line", F.xxhash64("w").alias("x"), n.alias("n"), m0.alias("m0"), p0.alias("p0"), s0.alias("s0"), m1.alias("m1"), p1.alias("p1"), s1.alias("s1"), F.when(n < near_words, F.xxhash64(F.lit(1), "w")).alias("y"))
    # 128 bits name a line: the hash of its words, and for longer lines that of its length and both ends
    seal = F.struct("x", F.coalesce("y", F.xxhash64("n", "p0", "s0")).alias("y")).alias("seal")
    lines = materialize(lines.select("doc_id", "told", "line", seal, "m0", "p0", "s0", "m1", "p1", "s1"), "lines")
    known = lines.groupBy("seal").agg(F.min(F.struct("doc_id", "told", "line")).alias("first"), F.count("*").alias("times"), *(F.min(c).alias(c) for c in ("m0", "p0", "s0", "m1", "p1", "s1")))
    known = materialize(known, "known")
    near = materialize(near_lines(known, docs, near_words).withColumn("near", F.lit(True)), "near")
    bad = known.select("seal", "first", "times").join(_bounded(near, near.count(), BROADCAST), "seal", "left").where("times > 1 or near").select("seal", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("doc_id", "told", "line", "seal").join(bad, "seal").where(F.col("near") | (F.struct("doc_id", "told", "line") != F.col("first")))
    return materialize(gone.select("doc_id", "told", "line").distinct().groupBy("doc_id", "told").agg(F.array_sort(F.collect_list("line")).alias("lines")), "gone")


def line_dedup(docs: DataFrame, least_words: int = 5, near_words: int = 10) -> DataFrame:
    """Every row of `docs`, all columns, with repeated lines taken out of text; and n_lines, n_dropped (long).

    Lines part at line feeds and are read as words (runs without ASCII white space). Of lines with `least_words` words
    or more and the same words, the earliest stays: smallest doc_id, then hash of the text, then line number. A line of `near_words` or more
    also goes if an earlier line of the table is within one word edit (at ten words that is 0.9 of it), whether or not
    that line itself stays. Lines under `least_words` always stay, and blank ones.

    Null texts and rows with a null doc_id pass unchanged (n_lines 0 for a null text). Rows that repeat a doc_id with
    another text are documents of their own; those that repeat doc_id and text are one, and lose the same lines. Very
    long texts and lines are read whole. Columns named like the two new ones are replaced. Empty in, empty out.
    """
    gone = dropped_lines(docs, least_words, near_words).select(F.col("doc_id").alias("__id"), F.col("told").alias("__told"), F.col("lines").alias("__gone"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lost = gone.agg(F.coalesce(F.sum(F.size("__gone")), F.lit(0))).first()[0]
    out = docs.select(*rest).withColumn("__own", F.xxhash64("text")).join(_bounded(gone, lost, FEW), (F.col("doc_id") == F.col("__id")) & (F.col("__own") == F.col("__told")), "left")
    parts = F.split("text", "\n")
    # the numbers that stay, by a hashed set, look their lines up in the text split once: linear in the lines
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    kept = F.array_join(F.transform(F.array(parts), lambda p: F.transform(stay, lambda i: F.get(p, i)))[0], "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept).alias("text")
    return out.select(*(text if c == "text" else F.col(c) for c in rest), F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"), F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("n_dropped"))
