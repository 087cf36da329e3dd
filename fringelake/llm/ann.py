"""Approximate nearest neighbours by adaptive dimension scan over an inverted file."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Vectors that the rotation's lists are fitted on at most (the documented bound of the index's sample).
SAMPLE = 20_000
#: Lists at most, and the rows that one task scans of a list; a longer list is dealt into segments.
LISTS, SEGMENT = 4096, 4096
#: Dimensions per column block.
BLOCK = 16
#: Strength of the test: a candidate goes when its partial distance is this many standard errors over the bound.
EPSILON = 3.0
#: Share of the sampled queries' true neighbours whose lists must be probed.
COVER = 0.985


def usable(vector: Column) -> Column:
    """Vectors without null or non-finite components and with a norm above zero."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _unit(rows: np.ndarray) -> np.ndarray:
    # the largest component first, so that no square over- or underflows
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, summed row by row in double precision: equal rows give equal doubles."""
    a, scale = a / np.abs(a).max(), np.abs(rows).max(axis=1)
    rows = rows / scale[:, None]
    return (rows * a).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((a * a).sum()))


def fit_lists(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Centres of spherical k-means, from an even spread of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        of = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        some = np.abs(sums).max(axis=1) > 0
        centres[some] = _unit(sums[some])
    return centres


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int, cover: float = COVER, queries: int = 400) -> int:
    """Lists to probe so that `cover` of the nearest of sampled queries, found by brute force, lie in them."""
    step = max(1, len(sample) // queries)
    mine = np.arange(0, len(sample), step)
    near = sample[mine] @ sample.T
    near[np.arange(len(mine)), mine] = -np.inf
    best = np.argsort(-near, axis=1)[:, :k]
    of = np.argmax(sample @ centres.T, axis=1)
    place = np.argsort(np.argsort(-(sample[mine] @ centres.T), axis=1), axis=1)
    ranks = np.sort(place[np.arange(len(mine))[:, None], of[best]].ravel())
    return int(ranks[min(len(ranks) - 1, math.ceil(cover * len(ranks)))]) + 1


def scan(query: np.ndarray, rows: np.ndarray, k: int, block: int = BLOCK, epsilon: float = EPSILON, bound: float = np.inf, step: int = 512) -> tuple[np.ndarray, float]:
    """Indices of rows that may be among the k nearest of a rotated unit query, and the bound reached.

    Rows are read in steps. After each block of columns a row's partial squared distance, scaled up to all dimensions,
    estimates the whole; rows whose estimate lies above the k-th best so far by more than the test allows are left.
    """
    dims, best, kept = rows.shape[1], np.zeros(0), []
    for at in range(0, len(rows), step):
        live, part = np.arange(at, min(at + step, len(rows))), None
        for d in range(0, dims, block):
            end = min(d + block, dims)
            gap = rows[live, d:end] - query[d:end]
            gap = np.einsum("ij,ij->i", gap, gap)
            part = gap if part is None else part + gap
            if end < dims and np.isfinite(bound):
                fine = part * (dims / end) <= bound * (1 + epsilon / math.sqrt(end)) ** 2 + 1e-9
                live, part = live[fine], part[fine]
                if not len(live):
                    break
        fine = part <= bound + 1e-9
        kept.append(live[fine])
        best = np.sort(np.concatenate([best, part[fine]]))[:k]
        if len(best) == k:
            bound = min(bound, best[-1])
    return (np.concatenate(kept) if kept else np.zeros(0, int)), bound


def _assigned(shared, queries: bool, every: int):
    """Each row's list, or with `queries` the lists that each query row probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, centres, probes = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            near = (_unit(flat) @ rotation) @ centres.T
            at = np.argpartition(-near, probes - 1, axis=1)[:, :probes] if queries and probes < len(centres) else np.tile(np.arange(len(centres)), (len(ids), 1)) if queries else np.argmax(near, axis=1)[:, None]
            width = at.shape[1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(np.arange(0, at.size + 1, width, dtype=np.int32), pa.array(at.ravel().astype(np.int32)))], ["id", "v", "lists"])

    return run


def _searched(shared, k: int):
    """Cells sorted so that a cell's rows come before the queries that probe it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = shared.value[0]
        now, held = None, []

        def out(ids, vectors, turned, qid, q):
            at, _ = scan((_unit(q[None]) @ rotation)[0], turned, k + 1)  # the query itself may be among the rows
            at = at[ids[at] != qid]
            score = cosines(q, vectors[at])
            best = np.lexsort((ids[at], -score))[:k]
            return ids[at][best], score[best]

        ready = None
        for b in batches:
            got: list[list] = [[], [], []]
            for cell, asks, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if cell != now:
                    now, held, ready = cell, [], None
                v = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not asks:
                    held.append((i, v))
                    continue
                if not held:
                    continue
                if ready is None:
                    vectors = np.array([h[1] for h in held])
                    ready = np.array([h[0] for h in held]), vectors, _unit(vectors) @ rotation
                ids, score = out(*ready, i, v)
                got[0] += [i] * len(ids)
                got[1] += ids.tolist()
                got[2] += score.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, every: int = 50, k: int = 5, sample: int = SAMPLE, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of each row whose id is divisible by `every`.

    Unit vectors are turned by a random rotation and dealt to lists by their nearest centre, which, like the number of
    lists probed, comes from a sample of at most `sample` rows; all rows are indexed. Within each probed list candidates
    are scanned in column blocks and left early by the hypothesis test of `scan`. What remains is scored exactly on the
    original vectors. A long list is dealt into segments that meet each of its queries, so a list with a third of all
    rows stays spread; each segment hands on k rows a query.

    Vectors null, zero or with null or non-finite components take no part, nor do those of another length than the
    sample's most frequent one, nor rows with a null id. With fewer candidates than k all found are given. Ties go to
    the smaller id. Rows that repeat an id are candidates each, but none for a query of that id. An empty table gives
    none; other columns are ignored.
    """
    spark = rows.sparkSession
    good = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = good.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    dims, total = sizes
    good = good.where(F.size("v") == dims)
    share = F.xxhash64("id", F.lit(5)).cast("double") / 2.0**64 + 0.5
    taken = good.where(share < sample / total).limit(2 * sample) if total > sample else good
    taken = taken.toArrow().sort_by([("id", "ascending")])
    points = np.array(taken["v"].to_pylist(), np.float64).reshape(-1, dims)
    rng = np.random.default_rng(3)
    rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    turned = _unit(points) @ rotation
    lists = max(1, min(LISTS, round(math.sqrt(total)), len(turned) // 20))
    centres = fit_lists(rng.permutation(turned), lists)
    probes = probes_needed(turned, centres, k) if len(turned) > k else lists
    shared = spark.sparkContext.broadcast((rotation, centres, min(probes, lists)))

    schema = "id long, v array<double>, lists array<int>"
    indexed = good.mapInArrow(_assigned(shared, False, every), schema).select("id", "v", F.col("lists")[0].alias("list"))
    indexed = materialize(indexed, "lists")
    parts = indexed.groupBy("list").agg(F.ceil(F.count("*") / SEGMENT).cast("int").alias("parts"))
    cells = indexed.join(F.broadcast(parts), "list").select(F.col("list"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "v")
    asked = good.where(F.col("id") % every == 0).dropDuplicates(["id"]).mapInArrow(_assigned(shared, True, every), schema).select("id", "v", F.explode("lists").alias("list"))
    asked = asked.join(F.broadcast(parts), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "id", "v")
    both = cells.unionByName(asked).select((F.col("list").cast("long") * (1 << 32) + F.col("part")).alias("cell"), "asks", "id", "v")
    found = both.repartition("cell").sortWithinPartitions("cell", "asks").mapInArrow(_searched(shared, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
