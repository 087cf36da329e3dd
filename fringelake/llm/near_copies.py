"""SimHash near copies at a Jaccard similarity: BK-trees inside shards propose, the sets of word shingles decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, counted, materialize, release, returning_memory

#: Minima that make one shard key.
ROWS = 5
#: Probability that a pair at exactly the least similarity shares no shard.
MISS = 1e-6
#: Differing bits up to which a tree's edges are followed; at 0.8 a pair exceeds them with a probability below 2e-6.
RADIUS = 28
#: Shingles that a bin of one permutation holds at least; fewer bins are made of smaller sets.
PER_BIN, MOST_BITS = 16, 8
#: Rounds in which trees of fingerprints alone propose one candidate a member, before what is still apart meets with its sets.
HUBS = 3
#: Members of a tree in these rounds; a larger shard is dealt anew in each.
PART = 512
#: Members of a tree; a larger shard is dealt into parts that meet pair by pair.
SHARD = 4096
#: Rows of a batch that go out at a time.
OUT = 256
#: Rows, and shingles of all sets, of a side of a join that are broadcast at most, some tens of MB.
FEW, FEW_SHINGLES = 1_000_000, 2_000_000


def shingles(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's word shingles; a text of fewer words is one shingle, an empty one none."""
    parts = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    words = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(parts[i : i + words]), seed) for i in range(len(parts) - words + 1)} if parts else set()
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def set_fingerprint(found: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingles."""
    ones = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view("<u8")[0])


def bands(similarity: float) -> int:
    """Keys of ROWS minima by which all but MISS of the pairs at `similarity` meet."""
    return math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS)) if similarity < 1 else 1


class Keys:
    """Shard keys of a set: hashes of ROWS minima each, over bins of random permutations.

    A set of n shingles fills up to n / PER_BIN bins of one permutation, so that a set costs a few thousand steps
    whatever its size. How many bins is a power of two; sets within `similarity` of the next one have the keys of both,
    so that any two sets that may match have the same number in common.
    """

    def __init__(self, similarity: float, seed: int):
        self.similarity, self.count = similarity, bands(similarity) * ROWS
        rng = np.random.default_rng(seed)
        self.flip, self.times = rng.integers(0, 1 << 64, (2, self.count), np.uint64)
        self.times |= np.uint64(1)

    def minima(self, found: np.ndarray, bits: int) -> np.ndarray:
        turns = -(-self.count >> bits)
        h = (found ^ self.flip[:turns, None]) * self.times[:turns, None]
        if not bits:
            return h.min(axis=1)
        h.sort(axis=1)
        flat = h.ravel()
        at = (np.arange(turns, dtype=np.int64)[:, None] << bits | (h >> np.uint64(64 - bits)).astype(np.int64)).ravel()
        first = np.flatnonzero(np.diff(at, prepend=-1))
        out = np.full(turns << bits, ~np.uint64(0))
        out[at[first]] = flat[first]
        return out[: self.count]

    def of(self, found: np.ndarray) -> list[int]:
        if not len(found):
            return []
        level = lambda n: min(MOST_BITS, max(0, int(math.log2(n / PER_BIN))))
        keys = []
        for bits in sorted({level(len(found)), level(len(found) / self.similarity + 1)}):
            low = self.minima(found, bits)
            keys += [xxhash.xxh64_intdigest(x.tobytes(), bits << 16 | k) for k, x in enumerate(low.reshape(-1, ROWS))]
        return keys


def _node(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes())


def _lists(parts: list) -> pa.ListArray:
    flat = np.concatenate([np.asarray(p, np.uint64) for p in parts]) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat.view(np.int64)))


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _marks(words: int, similarity: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(similarity, seed)
        for b in batches:
            for at in range(0, b.num_rows, OUT):
                part, rows = b.slice(at, OUT), []
                for x in part.column(1):
                    s = shingles(x.as_py() or b"", words, seed)
                    rows.append((_node(s), set_fingerprint(s) if len(s) else 0, len(s), keys.of(s)))
                node, fp, size, buckets = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0), _longs(node), _longs(fp), pa.array(size, pa.int32()), _lists(buckets)], ["doc_id", "node", "fp", "size", "buckets"])

    return run


def _sets(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, OUT):
                sets = [shingles(x.as_py() or b"", words, seed) for x in b.column(0).slice(at, OUT)]
                yield pa.RecordBatch.from_arrays([_longs([_node(s) for s in sets]), _lists(sets)], ["node", "found"])

    return run


class Tree:
    """A BK-tree of fingerprints whose walks take a whole frontier at a time."""

    def __init__(self, values: np.ndarray):
        plain, kids = values.tolist(), [{} for _ in values]
        for me, x in enumerate(plain[1:], 1):
            i = 0
            while (to := kids[i].get(d := (x ^ plain[i]).bit_count())) is not None:
                i = to
            kids[i][d] = me
        self.values = values
        self.start = np.cumsum([0, *map(len, kids)])
        self.child = np.array([c for k in kids for c in k.values()], np.int64)
        self.edge = np.array([e for k in kids for e in k], np.int64)

    def within(self, x: np.uint64, radius: int) -> np.ndarray:
        """Indices of values that differ from x in `radius` bits or fewer."""
        now, out = np.zeros(1, np.int64), []
        while len(now):
            d = np.bitwise_count(self.values[now] ^ x).astype(np.int64)
            out.append(now[d <= radius])
            many = self.start[now + 1] - self.start[now]
            at = np.repeat(self.start[now] - np.cumsum(many) + many, many) + np.arange(many.sum())
            now = self.child[at[np.abs(self.edge[at] - np.repeat(d, many)) <= radius]]
        return np.concatenate(out)


def proposals(roots: np.ndarray, prints: np.ndarray, sizes: np.ndarray, similarity: float, radius: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """For each member of a shard, one before it to be verified with it, or -1, and its candidates that aren't proposed.

    Candidates are what a walk of the shard's tree finds with another root and of a size that may match. The nearest
    one before a member is proposed, in later rounds the next ones, so that what failed isn't all that is tried.
    """
    tree, n = Tree(prints), len(prints)
    to, left = np.full(n, -1), np.zeros(n, np.int64)
    for i in range(n):
        near = tree.within(prints[i], radius)
        near = near[(roots[near] != roots[i]) & (np.minimum(sizes[near], sizes[i]) >= np.maximum(sizes[near], sizes[i]) * (similarity - 1e-9))]
        left[i] += len(near)
        near = near[near < i]
        if len(near):
            order = np.lexsort((near, np.bitwise_count(prints[near] ^ prints[i])))
            to[i] = near[order[min(turn, len(near) - 1)]]
            left[i] -= 1
            left[to[i]] -= 1
    return to, left


def _proposed(similarity: float, radius: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out():
            if len(held) < 2:
                return
            bucket, node, root, fp, size, parts = (np.array(x, np.int64) for x in zip(*held))
            to, left = proposals(root, fp.view(np.uint64), size, similarity, radius, turn)
            stays = (left > 0) | (parts > 1)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node), pa.array(node[to], mask=to < 0), pa.array(root), pa.array(root[to]), pa.array(stays)], ["bucket", "u", "v", "ru", "rv", "stays"])

        for b in batches:
            for shard, *row in zip(*(c.to_pylist() for c in b.columns)):
                if shard != now:
                    yield from out()
                    now, held = shard, []
                held.append(row)
        yield from out()

    return run


def shard_links(nodes: list[int], roots: list[int], prints: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int) -> list[tuple[int, int]]:
    """Links (u, v) by which all members join that are linked within the shard and whose roots differ.

    Each member outside the most frequent root walks the tree, and what it finds with another root is verified on the
    sets by counting through the shard's inverted lists. What is joined meanwhile isn't verified again.
    """
    up = {r: r for r in roots}

    def find(r):
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    tree, size = Tree(prints), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    known, first = np.unique(flat[order], return_index=True)
    owner, ends = owner[order], np.append(first, len(flat))
    most = max(up, key=roots.count) if len(up) < 64 else None
    out = []
    for i, x in enumerate(sets):
        if roots[i] == most:
            continue
        near = tree.within(prints[i], radius)
        mine = find(roots[i])
        near = np.array([j for j in near.tolist() if find(roots[j]) != mine], np.int64)
        if not len(near):
            continue
        at = np.searchsorted(known, x)
        same = np.bincount(np.concatenate([owner[ends[a] : ends[a + 1]] for a in at.tolist()]), minlength=len(sets))[near]
        for j in near[same >= (size[near] + size[i] - same) * similarity - 1e-9].tolist():
            a, b = find(roots[i]), find(roots[j])
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((nodes[i], nodes[j]))
    return out


def _shard_links(similarity: float, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def out():
            root = {n: h[0] for n, h in held.items()}
            if len(set(root.values())) < 2:
                return
            pairs = shard_links(list(held), list(root.values()), np.array([h[1] for h in held.values()], np.int64).view(np.uint64), [h[2] for h in held.values()], similarity, radius)
            yield pa.RecordBatch.from_arrays([pa.array([root[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], ["ru", "rv"])

        for b in batches:
            for bucket, node, root, fp, found in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4)):
                if bucket != now:
                    yield from out()
                    now, held = bucket, {}
                held[node] = root, fp, found.values.to_numpy(zero_copy_only=False).view(np.uint64).copy()
        yield from out()

    return run


def _bounded(side: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(side) if rows <= most else side


def _near(pairs: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, int]:
    """(ru, rv) of the pairs (u, v, ru, rv) of which the sets have the Jaccard similarity or more, written, and their number."""
    most, seen = counted(pairs.select(F.col("v").alias("node")).distinct().join(sets, "node"), "hubs", shingles=F.sum(F.size("found")))
    hubs = _bounded(most, seen["shingles"], FEW_SHINGLES)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("found").alias("a")), "u").join(hubs.select(F.col("node").alias("v"), F.col("found").alias("b")), "v")
    same = F.size(F.array_intersect("a", "b"))
    near = both.select("ru", "rv", F.size("a").alias("n"), F.size("b").alias("m"), same.alias("same")).where(F.col("same") >= (F.col("n") + F.col("m") - F.col("same")) * F.lit(similarity) - 1e-9)
    found, seen = counted(near.select("ru", "rv").distinct(), "near")
    release(most)
    return found, seen["rows"]


def _rooted(rows: DataFrame, step: DataFrame) -> DataFrame:
    """`rows` with the root that a step (node, root) gave to their `root`, where it gave one."""
    to = step.select(F.col("node").alias("root"), F.col("root").alias("__to"))
    return rows.join(to, "root", "left").select(*(F.coalesce("__to", "root").alias("root") if c == "root" else c for c in rows.columns))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = 42, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id reachable by links).

    Documents link if the sets of their word shingles have the Jaccard similarity or more, which is verified on the
    sets. Equal sets are one node, so copies are never pairs. A node lies in the shards that its minima name. Every
    candidate comes from a walk of a BK-tree of a shard's fingerprints, which follows only edges within the radius. In
    HUBS rounds a member proposes one candidate of another component in each shard, so that a dense group is joined at
    the cost of its members; one all of whose candidates were proposed leaves the shard. The members of a shard that
    are still of different components then get a tree that has their sets beside it, and what its walks find is verified
    where it lies: no pairs are sent. A shard over SHARD members is dealt into parts, and each two parts make a tree. `radius` and the number
    of keys are set for a similarity of 0.8 or more.

    Sets are made again, in a second scan, for the nodes that share a shard, and for no others. Null and empty texts
    have the empty set and are copies of each other; very long texts are read whole. A null doc_id never names a
    component that has another member; repeated rows and ids share a component only if their texts link. An empty table
    gives no rows, other columns are ignored.
    """
    narrow = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    marked = materialize(narrow.mapInArrow(returning_memory(_marks(words, similarity, seed)), f"doc_id {kind}, node long, fp long, size int, buckets array<long>"), "marked")
    keys = marked.select("node", "fp", "size", F.explode("buckets").alias("bucket"))
    shared = keys.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select("bucket")
    shared, seen = counted(shared, "shared")
    held = materialize(keys.join(_bounded(shared, seen["rows"], FEW), "bucket").distinct(), "held")
    nodes, seen = counted(held.select("node").distinct(), "nodes")
    few = seen["rows"]
    asked = marked.select("doc_id", "node").join(_bounded(nodes, few, FEW), "node").groupBy("node").agg(F.min("doc_id").alias("__id")).select("__id").distinct()
    texts = narrow.join(_bounded(asked, few, FEW), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")
    sets = texts.mapInArrow(returning_memory(_sets(words, seed)), "node long, found array<long>").join(_bounded(nodes, few, FEW), "node", "left_semi")
    sets = materialize(sets.groupBy("node").agg(F.any_value("found").alias("found")), "sets")

    steps = []  # for each round (node, root): the roots that it joined, on which the next one builds
    now = held.withColumn("root", F.col("node"))
    for turn in range(HUBS + 1):
        apart = now.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many")).where("low != high")
        if turn < HUBS:
            parts = F.ceil(F.col("many") / PART).cast("int")
            met = materialize(now.join(apart.select("bucket", parts.alias("parts")), "bucket"), "met")
            order = F.xxhash64("node", F.lit(turn))
            shard = F.when(F.col("parts") > 1, F.xxhash64("bucket", F.pmod(order, F.col("parts")))).otherwise(F.col("bucket"))
            dealt = met.select(shard.alias("shard"), "bucket", "node", "root", "fp", "size", "parts").repartition("shard").sortWithinPartitions("shard", order)
            walked = materialize(dealt.mapInArrow(returning_memory(_proposed(similarity, radius, turn)), "bucket long, u long, v long, ru long, rv long, stays boolean"), "walked")
            pairs = materialize(walked.where("v is not null").select("u", "v", "ru", "rv").distinct(), "pairs")
            found, joins = _near(pairs, sets, similarity)
            rest = met.drop("parts").join(walked.where("stays").select("bucket", F.col("u").alias("node")), ["bucket", "node"], "left_semi")
        else:
            parts = F.ceil(F.col("many") / SHARD).cast("int")
            left = now.join(apart.select("bucket", parts.alias("parts")), "bucket")
            own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
            left = left.select("node", "root", "fp", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
            shard = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
            left = left.select(shard.alias("bucket"), "node", "root", "fp").join(sets, "node").select("bucket", "node", "root", "fp", "found")
            found, seen = counted(left.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(returning_memory(_shard_links(similarity, radius)), "ru long, rv long").distinct(), "near")
            joins, rest = seen["rows"], None
        if joins:
            steps.append(connected_components(found.select(F.col("ru").alias("u"), F.col("rv").alias("v"))))
        release(found)
        if rest is not None:
            now, seen = counted(_rooted(rest, steps[-1]) if joins else rest, "now")
            release(met)
            release(walked)
            release(pairs)
            if not seen["rows"]:
                break
    for used in (shared, held, nodes, sets):
        release(used)
    lows = marked.groupBy("node").agg(F.min("doc_id").alias("low"), F.col("node").alias("root"))
    for step in steps:
        lows = _rooted(lows, step)
    lows = materialize(lows, "lows")
    named = lows.join(lows.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "component_id")
    return marked.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")
