"""SimHash near-dedup with BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, materialize

#: Members of one shard of a bucket; a larger bucket is dealt into shards whose trees meet pair by pair.
SHARD = 8192
#: Shingles hashed at a time, so that a very long text takes bounded memory.
STEP = 1 << 16


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text: bit b is set if it is set in over half the hashes of its word shingles."""
    parts = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not parts:
        return 0
    words = min(words, len(parts))
    line, size = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), STEP):
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[i : i + STEP], ends[i : i + STEP])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.fromiter((fingerprint(x.as_py() or b"", words, seed) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long; null and empty texts have 0."""
    narrow = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return narrow.mapInArrow(_fingerprints(words, seed), f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (member, root) that join all of `values` (distinct) that chains of `radius` or fewer bits join.

    Each value walks a BK-tree of those before it, along edges whose distance lies within `radius` of its own to the
    node, and then hangs itself up. A subtree whose nodes are all in the walker's component is passed by, so a dense
    group costs its depth and not its pairs.
    """
    node, kids, rep, mixed, up = [], [], [], [], []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for x in values:
        me = len(node)
        node.append(x), kids.append({}), rep.append(me), mixed.append(False), up.append(me)
        if not me:
            continue
        stack, mine = [0], me
        while stack:
            i = stack.pop()
            d = (x ^ node[i]).bit_count()
            if d <= radius:
                a, mine = find(i), find(me)
                if a != mine:
                    low, high = (a, mine) if a < mine else (mine, a)
                    up[high] = mine = low
            for edge, k in kids[i].items():
                if d - radius <= edge <= d + radius and (mixed[k] or find(rep[k]) != find(me)):
                    stack.append(k)
        i = 0
        while True:
            if not mixed[i] and find(rep[i]) != find(me):
                mixed[i] = True
            d = (x ^ node[i]).bit_count()
            if d not in kids[i]:
                kids[i][d] = me
                break
            i = kids[i][d]
    return [(node[i], node[r]) for i in range(len(node)) if (r := find(i)) != i]


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out():
            pairs = np.array(tree_links([x & 0xFFFFFFFFFFFFFFFF for x in held], radius), np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        for b in batches:
            for bucket, fp in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket != now:
                    if len(held) > 1:
                        yield out()
                    now, held = bucket, []
                if not held or held[-1] != fp:
                    held.append(fp)
        if len(held) > 1:
            yield out()

    return run


def link(distinct: DataFrame, count: int, radius: int = 3) -> DataFrame:
    """(u, v): links that connect whatever values fp of `distinct` chains of `radius` or fewer differing bits connect.

    Of b bit blocks, two values within the radius agree on at least b - radius; every choice of that many blocks and
    their bits names a shard, so all matches of a value lie in the shards it names. Each shard's BK-tree goes to the
    task that holds the shard's members and to no other, as a broadcast of all trees would grow with the corpus. b
    rises with the count of values so that shards keep a few hundred members. A shard over SHARD members is dealt into
    parts, and each pair of parts makes a tree of its own: nothing is capped.
    """
    blocks = radius + (1 if count < 30_000_000 else 2 if count < 10_000_000_000 else 3)
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = distinct.select("fp", F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)))).alias("bucket"))
    hot = keys.groupBy("bucket").count().where(F.col("count") > SHARD).select("bucket", F.ceil(F.col("count") / SHARD).cast("int").alias("parts"))
    keys = keys.join(hot, "bucket", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = keys.select("fp", "bucket", own.alias("own"), other.alias("other"))
    bucket = F.when(F.col("other").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
    keys = keys.select(bucket.alias("bucket"), "fp")
    return keys.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_links(radius), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Documents link if their fingerprints differ in `radius` or fewer bits. Equal fingerprints are grouped first, so
    copies cost one row each and never a pair. Null and empty texts have fingerprint zero and link like any other.
    Repeated rows and ties share a component; a null doc_id never names one that has another member. An empty table
    gives no rows, and other columns are ignored.
    """
    marked = materialize(fingerprints(docs, words, seed), "fingerprints")
    groups = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "groups")
    roots = connected_components(link(groups.select("fp"), groups.count(), radius))
    rooted = groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
