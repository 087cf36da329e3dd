"""Exact dedup by two-pass Bloom filtering."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release

#: Hash functions of the filter, each with its own segment of counters.
PROBES = 3
#: Counters per row, and the most counters of one filter (as bits, 32 MB broadcast). More rows than fit make more slices.
PER_ROW, MOST = 16, 1 << 28
#: Counters per piece in which partial filters travel.
PIECE = 1 << 16
#: A group of more rows is dealt into parts; HOT at most are broadcast for that, as more rows raise the bound.
PART, HOT = 4096, 100_000


def _slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counter of each hash in each of the PROBES segments of 2**bits counters."""
    h = hashes.view(np.uint64)
    odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    return [((h * np.uint64(odd[i])) >> np.uint64(64 - bits)).astype(np.int64) + (i << bits) for i in range(PROBES)]


def _partial(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b.column(0).to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if not got:
            return
        slots, counts = np.unique(np.concatenate(_slots(np.concatenate(got), bits)), return_counts=True)
        pieces, starts = np.unique(slots // PIECE, return_index=True)
        for many in (False, True):
            cols = [[], []]
            for p, lo, hi in zip(pieces, starts, [*starts[1:], len(slots)]):
                own = slots[lo:hi][(counts[lo:hi] > 1) == many]
                if len(own):
                    cols[0].append(int(p))
                    cols[1].append((own % PIECE).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([many] * len(cols[0]), pa.bool_()), pa.array(cols[1], pa.binary())], ["piece", "many", "slots"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by piece, so that one piece's saturating counters are held at a time."""
    now, counts = None, np.zeros(PIECE, np.uint8)

    def out():
        twice = np.flatnonzero(counts > 1).astype(np.uint16)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([twice.tobytes()], pa.binary())], ["piece", "slots"])

    for b in batches:
        for piece, many, slots in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if piece != now:
                if now is not None:
                    yield out()
                now = piece
                counts[:] = 0
            at = np.frombuffer(slots, np.uint16)
            counts[at] = 2 if many else np.minimum(counts[at] + 1, 2)
    if now is not None:
        yield out()


def possibly_repeated(hashes: DataFrame, bits: int) -> np.ndarray:
    """First pass over one slice: a packed filter that is set where a counter was met twice or more."""
    pieces = hashes.mapInArrow(_partial(bits), "piece long, many boolean, slots binary").repartition("piece").sortWithinPartitions("piece").mapInArrow(_merged, "piece long, slots binary")
    twice = np.zeros((PROBES << bits) // 8 + 1, np.uint8)
    for r in pieces.toLocalIterator():
        at = np.frombuffer(r.slots, np.uint16).astype(np.int64) + r.piece * PIECE
        np.bitwise_or.at(twice, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return twice


def _marked(part: DataFrame, twice: np.ndarray, bits: int) -> DataFrame:
    """Second pass over one slice: whether all counters of a row were met twice. The filter goes once this is written."""
    shared = part.sparkSession.sparkContext.broadcast(twice)

    @F.pandas_udf("boolean")
    def maybe(h):
        import pandas as pd

        held = shared.value
        return pd.Series(np.logical_and.reduce([held[s >> 3] >> (s & 7).astype(np.uint8) & 1 for s in _slots(h.to_numpy(), bits)]).astype(bool))

    out = materialize(part.withColumn("maybe", maybe("h")), "marked")
    shared.destroy()
    return out


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after every space, tab, line feed, vertical tab, form feed and carriage return is
    deleted. The row with the most code points, then the smallest doc_id, stays. The text is read once, into a narrow
    table of digests, parted by slices of the hash space when there are more rows than one filter of bounded size holds.
    Slice by slice, pass one counts 64-bit hashes in a Bloom filter with saturating counters, and pass two marks the
    rows whose counters were all met twice; one filter is held at a time. Marked rows are grouped by SHA-256, the rest
    go straight through. A false positive costs a shuffled row, never a wrong group.

    Null texts count as empty; empty texts are equal to each other. Repeated rows of one doc_id share a decision. A
    null doc_id loses ties. Very long texts are read whole. Other columns are ignored; an empty table gives none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    narrow = docs.select("doc_id", F.length(text).alias("points"), F.sha2(bare.cast("binary"), 256).alias("text_sha256"))
    total = docs.count()
    slices = max(1, math.ceil(total * PER_ROW / MOST))
    bits = max(12, math.ceil(math.log2(max(1, total / slices) * PER_ROW / PROBES)))
    narrow = materialize(narrow.withColumn("h", F.xxhash64("text_sha256")).withColumn("slice", F.pmod("h", F.lit(slices)).cast("int")), "digests", *(["slice"] if slices > 1 else []))
    done = []
    for k in range(slices):
        part = narrow.where(F.col("slice") == k) if slices > 1 else narrow
        done.append(_marked(part, possibly_repeated(part.select("h"), bits), bits))
    marked = functools.reduce(DataFrame.union, done)
    release(narrow)
    single = marked.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    rows = marked.where("maybe").select("doc_id", "points", "text_sha256")
    # ~doc_id turns the order round without overflow
    groups = rows.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.max(F.struct("points", F.bitwise_not("doc_id").alias("turned"))).alias("best"))
    groups = materialize(groups.select("text_sha256", "group_size", F.bitwise_not("best.turned").alias("keep_id")), "groups")
    # a group of many rows is dealt into parts, each with a copy of what was found, so that it is no one task
    most = max(PART, total // HOT)
    hot = F.broadcast(groups.where(F.col("group_size") > most).select("text_sha256", F.ceil(F.col("group_size") / most).cast("int").alias("parts")))
    rows = rows.join(hot, "text_sha256", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "points"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    parts = F.when(F.col("group_size") > most, F.ceil(F.col("group_size") / most).cast("int")).otherwise(1)
    groups = groups.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    shared = rows.join(groups, ["text_sha256", "part"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return single.unionByName(shared)
