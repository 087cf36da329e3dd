import hashlib
import random

import pytest
import xxhash

from fringelake.llm import exact_dedup, line_dedup, queries, shared, simhash
from fringelake.llm.simhash import tree_links

LONG = "lorem ipsum dolor " * 30_000


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(500)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        rows.append((i * 3, " ".join(base)))
        near = list(base)
        near[len(near) // 2] = "changed"
        rows.append((i * 3 + 1, " ".join(near)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One"), (1004, "one\n"), (1005, "two words"), (1006, LONG), (1007, LONG), (None, "One"), (5, rows[0][1])]
    return rows


def test_simhash_is_brute_force(make):
    rows = corpus()
    got = simhash.near_duplicates(make(rows)).collect()
    assert len(got) == len(rows)
    prints = [brute_fingerprint(t) for _, t in rows]
    pairs = [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 3]
    of = classes(pairs, set(prints))
    low = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            low[of[p]] = min(d, low.get(of[p], d))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{p:016x}", low[of[p]]) for (d, _), p in zip(rows, prints)}


@pytest.mark.parametrize("spread", [6, 12, 64])
def test_tree_links_lose_no_component(spread):
    rng = random.Random(spread)
    base = rng.getrandbits(64)
    values = list({base ^ sum(1 << b for b in rng.sample(range(spread), rng.randint(0, min(5, spread)))) for _ in range(300)})
    rng.shuffle(values)
    true = classes([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3], values)
    mine = classes(tree_links(values, 3), values)
    assert len(tree_links(values, 3)) == len(values) - len(set(mine.values()))
    assert true == mine


def test_large_buckets_are_dealt_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 8)
    rng = random.Random(1)
    values = list({sum(1 << b for b in rng.sample(range(20), 4)) for _ in range(150)})
    links = simhash.link(spark.createDataFrame([(v,) for v in values], "fp long"), len(values)).collect()
    true = classes([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3], values)
    assert classes([tuple(x) for x in links], values) == true


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (500, 501), (501, 500)]
    got = {r.node: r.root for r in shared.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == classes([e for e in edges if e[0] != e[1]], {x for e in edges if e[0] != e[1] for x in e})


def test_exact_dedup(make):
    rows = corpus() + [(2000, "a b"), (2001, "ab"), (2002, "a  b\n"), (2003, "ab "), (2001, "ab")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(make(rows)).collect()}
    groups = {}
    for d, t in rows:
        bare = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(hashlib.sha256(bare.encode()).hexdigest(), []).append((d, t or ""))
    want = set()
    for h, members in groups.items():
        keep = sorted(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0][0]
        want |= {(d, keep, len(members), d == keep, h) for d, _ in members}
    assert got == want


def test_bloom_slices_find_every_repeat(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST", 1 << 12)
    monkeypatch.setattr(exact_dedup, "PIECE", 1 << 7)
    rows = [(i, "t%d" % (i % 700)) for i in range(1000)]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in out if r.kept) == list(range(700)) and len(out) == 1000


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) and a[-1 - s] == b[-1 - s]:
        s += 1
    return p + s >= max(len(a), len(b)) - 1


def brute_lines(rows):
    """All distinct lines against all earlier ones."""
    first = {}
    told = lambda t: int.from_bytes(xxhash.xxh64_digest(t.encode(), 42), "big", signed=True)
    for d, h, t in sorted((r[0], told(r[1]), r[1]) for r in rows if r[0] is not None and r[1] is not None):
        for i, line in enumerate(t.split("\n")):
            w = tuple(x.decode() for x in line.encode().split())
            if len(w) >= 5:
                first.setdefault(w, (d, h, i))
    gone = {a for a in first if len(a) >= 10 and any(first[b] < first[a] and len(b) >= 10 and within_one(a, b) for b in first)}
    out = []
    for d, t in rows:
        if d is not None and t is not None:
            kept, t0 = [], t
            for i, line in enumerate(t.split("\n")):
                w = tuple(x.decode() for x in line.encode().split())
                if len(w) < 5 or (w not in gone and first[w] == (d, told(t0), i)):
                    kept.append(line)
            t = "\n".join(kept)
        out.append((d, t))
    return out


def line_rows():
    rng = random.Random(9)
    words = ["a", "b", "c", "dd", "ee"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 14))) for _ in range(60)]
    for _ in range(120):
        w = rng.choice(lines).split()
        k = rng.randrange(len(w))
        rng.choice([lambda: w.pop(k), lambda: w.insert(k, rng.choice(words)), lambda: w.__setitem__(k, rng.choice(words))])()
        lines.append("  ".join(w))
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for i in range(150)]
    return rows + [(900, None), (901, ""), (902, "\n\n"), (903, LONG[:90_000]), (904, LONG[:90_000] + "x"), (None, lines[0]), (905, "x y z\nx y z"), (0, rows[0][1]), (7, "another text of the same id\n" + lines[3]), (7, "and one more that is alone here")]


def test_rows_of_one_id_lose_their_own_lines(make):
    rows = [(1, "alpha beta gamma delta epsilon"), (2, "alpha beta gamma delta epsilon"), (2, "totally unique words stand here now")]
    assert sorted((r.doc_id, r.text) for r in line_dedup.line_dedup(make(rows)).collect()) == [(1, rows[0][1]), (2, ""), (2, rows[2][1])]


def test_line_dedup_is_brute_force(make):
    rows = line_rows()
    got = line_dedup.line_dedup(make(rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(brute_lines(rows), key=key)
    assert all(r.n_dropped == r.n_lines - (0 if r.text == "" and r.n_dropped == r.n_lines else len(r.text.split("\n"))) for r in got if r.text is not None)


def test_line_dedup_shuffles_the_same(make, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST", 0)
    monkeypatch.setattr(line_dedup, "FEW", 10**6)
    rows = line_rows()
    got = line_dedup.line_dedup(make(rows))
    assert {"lines", "word"} <= set(got.columns)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted(brute_lines(rows), key=key)


def test_line_query_drops_short_repeats(spark, make, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: make([(1, "Les.\n\none two three four"), (2, "Les.\n\n  \nAll rights reserved."), (3, "All  rights reserved.\none two three five\n"), (4, "one two three four")]))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in queries.op7_line_dedup(spark, "").collect()}
    assert got == {1: ("Les.\n\none two three four", 3, 0), 2: ("\n  \nAll rights reserved.", 4, 1), 3: ("one two three five\n", 3, 1), 4: ("", 1, 1)}


@pytest.mark.parametrize("f", [simhash.near_duplicates, exact_dedup.exact_dedup, line_dedup.line_dedup])
def test_empty_table(make, f):
    assert f(make([])).collect() == []


def test_dedup_of_one_row(make):
    assert [tuple(r)[:1] for r in simhash.near_duplicates(make([(4, "only")])).collect()] == [(4,)]


def test_very_many_equal_lines_take_time_that_grows_with_them(make):
    """100,000 equal lines of one text, and as many that stay, take seconds."""
    import time

    from fringelake.llm import line_dedup

    lines = ["the same five words here"] * 100_000 + [f"line number {i} has its own words" for i in range(1000)]
    began = time.time()
    (row,) = line_dedup.line_dedup(make([(1, "\n".join(lines))])).select("text", "n_lines", "n_dropped").collect()
    assert row.n_lines == 101_000 and row.n_dropped == 99_999
    assert row.text == "\n".join(lines[99_999:])
    assert time.time() - began < 40
