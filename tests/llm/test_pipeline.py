"""Each stage of the corpus pipeline against a plain version of its decisions."""

import random
from collections import Counter

import corpus_pipeline as cp
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_lines, classes, line_rows
from test_learned import langs, mix_rows

from fringelake.llm import langid, mixing, near_copies, simhash
from fringelake.llm.shared import remainder


def texts(rows):
    return Counter((r[0], r[1]) for r in rows)


def test_stages_are_named_in_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash", "mixing", "bpe"]


def test_language_stage_keeps_what_is_identified(make, spark):
    docs = make(langs())
    own = langid.with_language(docs, remainder("doc_id", 3) == 1)
    assert own.columns == [*(c for c in docs.columns if c != "score"), "lang_pred", "score"]
    plain = langid.identify(docs, remainder("doc_id", 3) == 1)
    assert Counter((r.doc_id, r.lang_pred, r.score) for r in own.collect()) == Counter((r.doc_id, r.lang_pred, r.score) for r in plain.collect())
    got = cp.language_id(spark, docs, "").collect()
    left = Counter(r.doc_id for r in plain.collect() if r.lang_pred != "und" and r.score >= cp.SURE)
    assert Counter(r.doc_id for r in got) == left and not {900, 901, 902} & set(left) and left[904] == 2


def test_line_stage_is_brute_force(make, spark):
    rows = line_rows()
    got = cp.without_repeated_lines(spark, make(rows), "")
    assert got.columns == cp.COLUMNS
    want = [new for old, new in zip(rows, brute_lines(rows)) if new[1] == old[1] or (new[1] or "").strip()]
    assert texts(got.collect()) == texts(want)


@pytest.mark.parametrize("few", [cp.FEW, -1])
def test_simhash_stage_keeps_one_of_each_group(make, spark, monkeypatch, few):
    monkeypatch.setattr(cp, "FEW", few)
    rows = [(i, f"alpha{i % 9} beta{i % 9} gamma{i % 9} delta{i % 9} eps{i % 9}") for i in range(60)]
    rows += [(70, None), (71, ""), (72, "one two three"), (72, "one two three"), (None, "all alone in here")]
    docs = make(rows)
    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    want = [r for r in rows if component[r[0]] == r[0]]
    assert texts(cp.without_near_duplicates(spark, docs, "").collect()) == texts(want)


def test_mixing_stage_repeats_documents_as_taken(make, spark):
    rows = [*mix_rows(), (903, "p q r", None, "a"), (903, "s t", None, "a"), (903, "s t", None, "b"), (None, "z z", None, "a")]
    docs = make(rows)
    size = lambda t: len((t or "").split())
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r.source, r.size] += r.taken
    got = Counter()
    for r in cp.mixed(spark, docs, "").collect():
        got[r.doc_id, r.source, size(r.text)] += size(r.text)
    assert got == +taken


@pytest.mark.parametrize("copies", [1, 2, 3])
def test_mixing_stage_deals_uneven_copies(make, spark, monkeypatch, copies):
    took = [(1, 2, 2 * (copies > i) + 2 * (copies > i + 2), "a") for i in range(2)]
    monkeypatch.setattr(mixing, "mix", lambda docs: spark.createDataFrame(took, "doc_id long, size long, taken long, source string"))
    got = Counter(r.text for r in cp.mixed(spark, make([(1, "x y", None, "a"), (1, "z z", None, "a")]), "").collect())
    assert sum(got.values()) == copies and max(got.values()) - min(got.values()) <= 1 or copies == 1


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES])
def test_stages_of_an_empty_table(make, spark, stage):
    assert stage(spark, make([]), "").collect() == []


def test_run_over_whole_tables(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    assert out.count() > 0 and out.join(ids, "doc_id", "left_anti").isEmpty()
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def brute_near(rows):
    """Smallest id of each row's group, by the Jaccard similarity of all pairs of five-word shingle sets."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = classes(near, range(len(rows)))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[group[i]] = min(d, low.get(group[i], d))
    return near, [low.get(group[i]) for i in range(len(rows))]


def near_rows():
    rng = random.Random(6)
    words = ["w%d" % i for i in range(300)]
    rows = [(1000, None), (1001, ""), (1002, "one two"), (1003, "One  two")]
    for i in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(30, 250))]
        for j in range(5):
            near = list(base)
            for _ in range(len(base) * j // 100):
                near[rng.randrange(len(near))] = "changed%d" % j
            rows.append((i * 5 + j, " ".join(near)))
    passage = " ".join(words[:40])
    rows += [(2000 + i, passage + " " + " ".join(rng.choice(words) for _ in range(60))) for i in range(20)]
    return rows


@pytest.mark.parametrize(("hubs", "shard"), [(3, 4096), (0, 4096), (1, 8)])
def test_simhash_stage_finds_all_of_similarity_four_fifths(make, spark, monkeypatch, hubs, shard):
    monkeypatch.setattr(near_copies, "HUBS", hubs)
    monkeypatch.setattr(near_copies, "SHARD", shard)
    rows = near_rows()
    near, low = brute_near(rows)
    by_bits = {r.doc_id: r.component_id for r in simhash.near_duplicates(make(rows)).collect()}
    assert sum(by_bits[rows[i][0]] != by_bits[rows[j][0]] for i, j in near) > 20  # more than the digests' radius joins
    got = cp.without_near_duplicates(spark, make(rows), "").collect()
    assert texts(got) == texts([r for r, d in zip(rows, low) if r[0] == d])


def test_trees_find_all_within_the_radius():
    rng = random.Random(4)
    base = rng.getrandbits(64)
    values = np.array([base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 40))) for _ in range(300)], np.uint64)
    tree = near_copies.Tree(values)
    for x in values[:40]:
        assert sorted(tree.within(x, 20).tolist()) == [i for i, v in enumerate(values.tolist()) if (v ^ int(x)).bit_count() <= 20]


@pytest.mark.parametrize("size", [3, 30, 200, 900, 9000])
def test_sets_of_the_similarity_share_a_key(size):
    rng = np.random.default_rng(size)
    keys = near_copies.Keys(0.8, 42)
    for _ in range(20):
        every = rng.integers(0, 1 << 64, size, np.uint64)
        both = set(keys.of(np.sort(every))) & set(keys.of(np.sort(every[: -(-size * 4 // 5)])))
        assert both
    assert len(keys.of(np.sort(every))) <= 2 * near_copies.bands(0.8)


@pytest.mark.parametrize("hubs", [3, 0])
def test_every_candidate_comes_from_a_walk_of_a_tree(make, spark, tmp_path, monkeypatch, hubs):
    """Trees that find nothing leave every text, however the shards' members meet."""
    proposed, links = getattr(near_copies, "_proposed", None), near_copies._shard_links

    def blind(kernel, *settings):
        def run(batches):
            within, near_copies.Tree.within = near_copies.Tree.within, lambda self, x, radius: np.zeros(0, np.int64)
            try:
                yield from kernel(*settings)(batches)
            finally:
                near_copies.Tree.within = within

        return run

    monkeypatch.setattr(near_copies, "HUBS", hubs)
    monkeypatch.setattr(near_copies, "_proposed", raising=False, value=lambda *a: blind(proposed, *a))
    monkeypatch.setattr(near_copies, "_shard_links", lambda *a: blind(links, *a))
    rows = list({r[1]: r for r in near_rows() if r[0] < 150}.values())
    assert len(brute_near(rows)[0]) > 20
    assert cp.without_near_duplicates(spark, make(rows), "").count() == len(rows)
