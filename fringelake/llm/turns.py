"""Repair of conversations: the cheapest edits that make the roles alternate, by folds of Spark SQL.

The rows of a conversation are taken by turn (nulls first), ties by role and then by the SHA-256 of the text. Kept rows
must read `(s?(ua)+)?` by the first letters of their roles. Four states say what was read last: nothing, a system row, a
user row, an assistant row. One fold over the sorted rows carries the cheapest (cost, audit) of each state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of rerole, delete and insert, and what a truncated row that stays adds.
REROLED, DELETED, INSERTED, TRUNCATED = 1, 2, 5, 5
#: Pairs of first letters that may follow each other.
LEGAL = ("su", "ua", "au")
#: Conversations of more rows than this are folded in segments of so many rows, which are then joined.
SEGMENT = 512
#: Ids of long conversations are broadcast up to so many.
FEW = 1_000_000
STATES = range(4)
#: What a state holds; folds over segments also hold 4 * (state before) + (state after) of each segment.
STATE, STATE_OF_SEGMENTS = "struct<cost:bigint,audit:string>", "struct<cost:bigint,audit:string,path:array<int>>"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) damaged by crc32 of `conv_id:turn` modulo 20; dropped rows have 0 copies.

    0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` out, 3 makes two copies of it, 4 makes it the user's.
    Null ids and turns are spelt as one space in the hashed text; null roles and texts become one space.
    """
    spelt = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(spelt[0], F.lit(":"), spelt[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _grow(state: Column, cost: Column | int, letter: str, kind: str = STATE) -> Column:
    """The state after one more edit; null (not reachable) stays null."""
    path = [state["path"].alias("path")] if kind == STATE_OF_SEGMENTS else []
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], F.lit(letter)).alias("audit"), *path))


def _states(*found: Column, kind: str = STATE) -> Column:
    return F.struct(*[f.cast(kind).alias(f"s{k}") for k, f in zip(STATES, found, strict=True)])


def _inserted(now: Column, kind: str = STATE) -> Column:
    """States after user or assistant rows are put in, where that is cheaper."""
    user = F.least(now["s2"], *[_grow(now[f"s{k}"], INSERTED, INSERT, kind) for k in (0, 1, 3)])
    return _let(user, lambda u: _states(now["s0"], now["s1"], u, F.least(now["s3"], _grow(u, INSERTED, INSERT, kind)), kind=kind))


def _edited(now: Column, row: Column) -> Column:
    """States after one row: deleted, kept where its letter fits, or given the role that fits."""
    extra = F.when(row["fault"] == "truncated", TRUNCATED).otherwise(0).cast("long")
    free = ~row["fault"].isin("blank", "duplicate")

    def taken(k: int, letter: str) -> Column:
        same = row["initial"] == letter
        return F.when(free & same, _grow(now[f"s{k}"], extra, KEEP)).when(free, _grow(now[f"s{k}"], extra + REROLED, REROLE))

    gone = [_grow(now[f"s{k}"], DELETED, DELETE) for k in STATES]
    system = F.when(free & (row["initial"] == "s"), _grow(now["s0"], extra, KEEP))
    return _states(gone[0], F.least(gone[1], system), F.least(gone[2], *[taken(k, "u") for k in (0, 1, 3)]), F.least(gone[3], taken(2, "a")))


def fold(rows: Column, start: int) -> Column:
    """The cheapest (cost, audit) of each state after `rows`, from state `start`; null where it can't be reached."""
    none, zero = F.lit(None), F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    begin = _states(*[zero if k == start else none for k in STATES])
    return F.aggregate(rows, begin, lambda now, row: _let(_inserted(now), lambda put: _edited(put, row)))


def ended(states: Column, kind: str = STATE) -> Column:
    """The cheapest end: nothing kept, or an assistant row last, put in if need be."""
    return _let(_inserted(states, kind), lambda now: F.least(now["s0"], now["s3"]))


def fold_segments(segments: Column) -> Column:
    """The same over folded segments, each with the states `from0` to `from3` that it leads to from each state."""
    zero = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"), F.array().cast("array<int>").alias("path"))

    def through(now: Column, segment: Column, k: int, j: int) -> Column:
        here, there = now[f"s{k}"], segment[f"from{k}"][f"s{j}"]
        both = F.struct((here["cost"] + there["cost"]).alias("cost"), F.concat(here["audit"], there["audit"]).alias("audit"), F.concat(here["path"], F.array(F.lit(4 * k + j))).alias("path"))
        return F.when(here.isNotNull() & there.isNotNull(), both)

    step = lambda now, segment: _states(*[F.least(*[through(now, segment, k, j) for k in STATES]) for j in STATES], kind=STATE_OF_SEGMENTS)
    return F.aggregate(segments, _states(zero, *[F.lit(None)] * 3, kind=STATE_OF_SEGMENTS), step)


def replay(rows: Column, audit: Column, user_next: Column) -> Column:
    """The lines `role:text` that the edits of `audit` leave of `rows`."""
    begin = F.struct(F.lit(0).alias("at"), user_next.alias("user"), F.array().cast("array<string>").alias("lines"))

    def step(now: Column, letter: Column) -> Column:
        row = F.get(rows, now["at"])
        system = (letter == KEEP) & (row["initial"] == "s")
        role = F.when(letter == KEEP, row["role"]).when(now["user"], "user").otherwise("assistant")
        line = F.concat(role, F.lit(":"), F.when(letter == INSERT, "").otherwise(row["text"]))
        return F.struct(
            (now["at"] + F.when(letter == INSERT, 0).otherwise(1)).alias("at"),
            F.when((letter == DELETE) | system, now["user"]).otherwise(~now["user"]).alias("user"),
            F.when(letter == DELETE, now["lines"]).otherwise(F.concat(now["lines"], F.array(line))).alias("lines"),
        )

    return F.aggregate(F.filter(F.split(audit, ""), lambda x: x != ""), begin, step, lambda now: now["lines"])


def _fault(first: Column) -> Column:
    """blank, duplicate, truncated, or none of them; `first`: no earlier row has this role and text."""
    inked = F.col("text").rlike(f"[^{SPACE}]")
    return F.when(~inked, "blank").when(~first, "duplicate").when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), "truncated").otherwise("none")


def _initial() -> Column:
    return F.substring("role", 1, 1)


def _result(cost: Column, audit: Column, lines: Column) -> list[Column]:
    none = F.lit(0).cast("long")
    counts = [F.coalesce(F.col(c), none).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")]
    return ["conv_id", *counts, F.coalesce(cost, none).alias("cost"), F.coalesce(audit, F.lit("")).alias("audit"), F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256")]


def _counts() -> list[Column]:
    return [F.count_if(F.col("fault") == c).alias(c) for c in ("blank", "duplicate", "truncated")]


def _gaps(distinct: Column) -> Column:
    return F.coalesce(F.max("turn") - F.min("turn") + 1 - distinct, F.lit(0)).cast("long").alias("gaps")


def _row() -> Column:
    """A row as the folds take it, after the columns that order it."""
    return F.struct("turn", "role", "digest", "nth", "initial", "text", "fault")


def _short(damaged: DataFrame) -> DataFrame:
    """Conversations of bounded length: one shuffle by conv_id, windows for the faults, one fold for each."""
    copies = F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))
    rows = damaged.repartition("conv_id").withColumn("gone", F.col("copies") == 0).withColumn("digest", F.sha2("text", 256)).withColumn("copy", copies)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "digest").orderBy("turn"))).withColumn("initial", _initial())
    before = F.lag("initial").over(Window.partitionBy("conv_id", "gone").orderBy("turn", "role", "digest", "nth"))
    stays = ~F.col("gone")
    rows = rows.withColumn("fault", F.when(stays, _fault(F.col("nth") == 1))).withColumn("turn", F.when(stays, F.col("turn")))
    rows = rows.withColumn("illegal", stays & before.isNotNull() & ~F.concat(before, F.col("initial")).isin(*LEGAL))
    of = F.sort_array(F.collect_list(F.when(stays, _row())))
    found = rows.groupBy("conv_id").agg(of.alias("rows"), _gaps(F.size(F.collect_set("turn"))), *_counts(), F.count_if("illegal").alias("illegal"))
    found = found.withColumn("best", ended(fold(F.col("rows"), 0)))
    return found.select(*_result(F.col("best.cost"), F.col("best.audit"), replay(F.col("rows"), F.col("best.audit"), F.lit(True))))


def _long(damaged: DataFrame) -> DataFrame:
    """Conversations of any length: segments folded from each of the four states, and a fold over the segments.

    Equal rows are counted before they are shuffled, the earliest turn of a (role, text) is a grouped minimum, and
    segments are ranges of the order, so that a conversation with a third of all rows stays spread over tasks until its
    result's row, which holds the audit and for a moment the text that is hashed.
    """
    ids = damaged.groupBy("conv_id").agg(F.lit(1).alias("one"))
    same = damaged.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    same = materialize(same.withColumn("digest", F.sha2("text", 256)), "turns-same")
    firsts = same.groupBy(*[F.col(c).alias(f"__{c}") for c in ("conv_id", "role", "digest")]).agg(F.min(F.struct("turn")).alias("__first"))
    on = F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("role") == F.col("__role")) & (F.col("digest") == F.col("__digest"))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / SEGMENT)))
    rows = same.join(firsts, on).withColumn("piece", piece).select(
        "conv_id", "turn", "role", "digest", "piece", "text", F.least(F.lit(SEGMENT), F.col("copies") - F.col("piece") * SEGMENT).cast("int").alias("many"),
        (F.struct("turn").eqNullSafe(F.col("__first")) & (F.col("piece") == 0)).alias("leads"),
    )
    order = ["turn", "role", "digest", "piece"]
    rows = materialize(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns-parts")
    upto = F.sum("many").over(Window.partitionBy("conv_id", "part").orderBy(*order))
    rows = rows.withColumn("segment", F.floor((upto - F.col("many")) / SEGMENT)).withColumn("initial", _initial())
    of = F.sort_array(F.collect_list(F.struct(*order, "initial", "text", "many", "leads", _fault(F.lit(True)).alias("fault"), _fault(F.lit(False)).alias("later"))))

    def copies(r: Column) -> Column:
        one = lambda fault: F.struct(r["initial"].alias("initial"), r["role"].alias("role"), r["text"].alias("text"), fault.alias("fault"))
        return F.concat(F.array_repeat(one(r["fault"]), r["leads"].cast("int")), F.array_repeat(one(r["later"]), r["many"] - r["leads"].cast("int")))

    parts = rows.groupBy("conv_id", "part", "segment").agg(F.flatten(F.transform(of, copies)).alias("rows"))
    parts = materialize(parts.select("*", *[fold(F.col("rows"), k).alias(f"from{k}") for k in STATES]), "turns-segments")
    pair = lambda i: F.concat(F.get("rows", i - 1)["initial"], F.get("rows", i)["initial"])
    inside = F.size(F.filter(F.sequence(F.lit(0), F.size("rows") - 1), lambda i: (i > 0) & ~pair(i).isin(*LEGAL)))
    ends = F.struct("part", "segment", *[f"from{k}" for k in STATES], F.get("rows", F.lit(0))["initial"].alias("first"), F.element_at("rows", -1)["initial"].alias("last"))
    number = lambda kind: F.size(F.filter("rows", lambda r: r["fault"] == kind))
    faults = {c: number(c) for c in ("blank", "duplicate", "truncated")}
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(ends)).alias("ends"), *[F.sum(n).alias(c) for c, n in faults.items()], F.sum(inside).alias("inside"))
    between = lambda i: F.concat(F.get("ends", i - 1)["last"], F.get("ends", i)["first"])
    breaks = F.size(F.filter(F.sequence(F.lit(0), F.size("ends") - 1), lambda i: (i > 0) & ~between(i).isin(*LEGAL)))
    whole = materialize(whole.withColumn("illegal", F.col("inside") + breaks).withColumn("best", ended(fold_segments(F.col("ends")), STATE_OF_SEGMENTS)), "turns-whole")
    way = whole.select(F.col("conv_id").alias("__conv_id"), "ends", F.posexplode("best.path").alias("i", "way")).withColumn("end", F.get("ends", "i"))
    audit = F.coalesce(*[F.when(F.col("way") == 4 * k + j, F.col("end")[f"from{k}"][f"s{j}"]["audit"]) for k in STATES for j in STATES])
    way = way.select("__conv_id", F.col("end.part").alias("__part"), F.col("end.segment").alias("__segment"), audit.alias("audit"), (F.floor(F.col("way") / 4) != 2).alias("user"))
    here = F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("part") == F.col("__part")) & (F.col("segment") == F.col("__segment"))
    lines = parts.join(way, here).select("conv_id", F.struct("part", "segment", replay(F.col("rows"), F.col("audit"), F.col("user")).alias("lines")).alias("lines"))
    lines = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list("lines")).alias("lines"))
    # what the last fold puts in after all rows: a user row too where the last row read is a system row
    state = F.element_at("best.path", -1) % 4
    last = F.when(state == 2, F.array(F.lit("assistant:"))).when(state == 1, F.array(F.lit("user:"), F.lit("assistant:"))).otherwise(F.array().cast("array<string>"))
    gaps = same.groupBy("conv_id").agg(_gaps(F.count_distinct("turn")))
    found = ids
    for side in (whole, gaps, lines):
        side = side.withColumnRenamed("conv_id", "__conv_id")
        found = found.join(side, F.col("conv_id").eqNullSafe(F.col("__conv_id")), "left").drop("__conv_id")
    texts = F.concat(F.flatten(F.transform("lines", lambda x: x["lines"])), last)
    return found.select(*_result(F.col("best.cost"), F.col("best.audit"), F.coalesce(texts, F.array().cast("array<string>"))))


def repair(conversations: DataFrame, segment: int | None = None) -> DataFrame:
    """One row for each conv_id of `conversations` (conv_id, turn, role, text), which are damaged first (see `damage`).

    Faults are counted by a row's first one: blank, duplicate (role and text seen earlier), truncated. `gaps` are turns
    missing between the first and the last, `illegal` are neighbours whose first letters may not follow each other,
    `cost` and `audit` the cheapest edits (ties: ASCII-least audit), `repaired_sha256` the hash of the lines left.
    Null turns come first and count in no gap, null ids are one conversation, null roles and texts are one space, which
    is blank. Empty texts are blank; long ones are read whole. Ties of a turn are ordered by role, then by the SHA-256
    of the text; rows that repeat are duplicates. A conversation whose rows all go has zeros, an empty audit and the
    hash of nothing; an empty table gives no rows. Other columns are not read, whatever their names.
    Conversations of more than SEGMENT rows are folded in segments, with the same result.
    """
    rows = damage(conversations.select("conv_id", "turn", "role", "text"))
    big = conversations.groupBy("conv_id").count().where(F.col("count") > (segment or SEGMENT)).select(F.col("conv_id").alias("__id"))
    big = materialize(big, "turns-big")
    n = big.count()
    if not n:
        return _short(rows)
    side = F.broadcast(big) if n <= FEW else big
    one = F.col("conv_id").eqNullSafe(F.col("__id"))
    return _short(rows.join(side, one, "left_anti")).unionByName(_long(rows.join(side, one, "left_semi")))
