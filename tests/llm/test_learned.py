import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.llm import langid, lm, mixing, toxicity
from fringelake.llm.shared import remainder

LANGS = {"xx": "the of and to in that".split(), "yy": "der und ist nicht mit ein".split(), "zz": "que los para una del".split()}


def langs():
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(LANGS[k]) for _ in range(40)), k, "s") for i, k in enumerate(rng.choice(sorted(LANGS)) for _ in range(200))]
    return rows + [(900, None, "xx", "s"), (901, "", "yy", "s"), (902, "12 34 !!", "xx", "s"), (903, "the of and " * 60_000, None, "s"), (904, "the and", None, None), (904, "the and", None, None), (None, "der und ist", "yy", "s")]


def test_language_id(make):
    rows = langs()
    got = langid.identify(make(rows), remainder("doc_id", 3) == 1).collect()
    assert len(got) == len(rows)
    true = {r[0]: r[2] for r in rows}
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif true[r.doc_id]:
            assert r.lang_pred == true[r.doc_id]
        else:
            assert r.lang_pred == "xx"


def test_language_id_of_nothing(make):
    assert langid.identify(make([]), F.lit(False)).collect() == []
    assert {(r.lang_pred, r.score) for r in langid.identify(make([(1, "the", None, None), (2, None, None, None)]), F.lit(False)).collect()} == {("und", 0.0)}


def test_grams_in_steps_are_those_of_the_whole(monkeypatch):
    text = "Ab cdé fg 12 hij kl" * 9
    whole = np.concatenate(list(langid.grams(text)))
    monkeypatch.setattr(langid, "STEP", 7)
    assert Counter(np.concatenate(list(langid.grams(text))).tolist()) == Counter(whole.tolist())


def toxic_rows():
    rng = random.Random(5)
    words = ["word%s" % chr(97 + i) for i in range(26)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = [rng.choice(words) for _ in range(30)] + (["horrid", "vile"] if bad else [])
        if i % 7 == 0 or (bad and i % 2):
            text.append("muslim")
        rng.shuffle(text)
        rows.append((i, " ".join(text), None, None))
        labels.append((i, 1, int(bad)))
    return rows + [(900, None), (901, ""), (902, "word " * 80_000), (None, "vile")], labels + [(950, 0, 1), (901, 0, None), (3, 1, 0)]


def test_toxicity(make, spark):
    rows, labels = toxic_rows()
    got = toxicity.score(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), remainder("doc_id", 4) == 2).collect()
    true = {i: t for i, _, t in labels}
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None and r.doc_id < 600:
            assert r.predicted == true[r.doc_id]
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_swaps_lower_scores_of_neutral_mentions(make, spark):
    """The penalty through score(): neutral texts that name a group fare better with it, toxic ones are still found."""
    rng = random.Random(12)
    words, rows, labels = ["word%s" % chr(97 + i) for i in range(26)], [], []
    for i in range(800):
        bad = i % 4 == 0
        text = [rng.choice(words) for _ in range(20)] + (["horrid"] if bad and i % 8 else [])
        if bad or i % 50 == 1:
            text.append("muslim")
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    neutral = [(10_000 + i, " ".join(rng.choice(words) for _ in range(20)) + " muslim") for i in range(60)]
    table, mean, flagged = spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {}, {}
    for penalty in (0.0, 20.0):
        got = toxicity.score(make(rows + neutral), table, F.lit(False), penalty=penalty).collect()
        mean[penalty] = sum(r.score for r in got if r.doc_id >= 10_000) / 60
        flagged[penalty] = sum(r.predicted for r in got if r.doc_id >= 10_000)
        assert sum(r.predicted for r in got if r.doc_id < 800 and r.doc_id % 8 == 4) == 100
    assert mean[20.0] < 0.6 * mean[0.0] and flagged[20.0] < flagged[0.0]


def test_toxicity_without_labels(make, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score(make([(1, "a"), (2, None)]), none, F.lit(False)).collect()} == {0}
    assert toxicity.score(make([]), none, F.lit(False)).collect() == []


def test_counterfactual_penalty_takes_weight_from_identity_terms():
    rng = np.random.default_rng(1)
    own, swaps, labels = [], [], []
    term, peer, bad = np.uint32(7), np.uint32(8), np.uint32(9)
    for i in range(400):
        toxic = i % 2
        features = {int(x) for x in rng.integers(100, 140, 5)} | ({int(bad)} if toxic and i % 4 == 1 else set())
        if toxic or i % 8 == 0:
            swaps.append((i, np.array(sorted(features | {int(peer)}), np.uint32)))
            features |= {int(term)}
        own.append(np.array(sorted(features), np.uint32))
        labels.append(toxic)
    weight = {}
    for penalty in (0.0, 50.0):
        names, w, _ = toxicity.train(own, np.array(labels), swaps, penalty=penalty)
        weight[penalty] = dict(zip(names.tolist(), w)).get(7, 0.0)
    assert weight[0.0] > 1 and abs(weight[50.0]) < weight[0.0] / 3


def lm_rows():
    rng = random.Random(8)
    a, b = ["a%d" % i for i in range(40)], ["b%d" % i for i in range(40)]
    rows = [(i, " ".join(rng.choice(a if k % 2 else b) for k in range(30))) for i in range(150)]
    return rows + [(900, None), (901, ""), (902, "A1 a1İ new word"), (902, "A1 a1"), (903, "a1 " * 50_000), (None, "a1 b1")]


@pytest.mark.parametrize("head", [lm.HEAD, 20])
def test_class_lm(make, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    rows = lm_rows()
    got = lm.score(make(rows), remainder("doc_id", 7) == 2).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t in rows:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))
        want[(d, held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    some = [r for r in got if r.held_out and r.n_tokens == 31]
    assert sum(r.score for r in some) > sum(r.base_score for r in some) and all(r.score < 0 for r in got)


def test_class_lm_of_nothing(make):
    assert lm.score(make([]), F.lit(False)).collect() == []
    one = lm.score(make([(1, "x")]), F.lit(True)).first()
    assert (one.n_tokens, one.n_known, one.train_tokens) == (2, 0, 0)


def brute_class_lm(rows, held):
    """Scores of the class model by plain loops over all tokens; the classes of the most frequent types are `lm.exchange`'s."""
    tokens = [[*(t or "").encode().lower().split(), lm.END] for _, t in rows]
    learned = [x for x, (d, _) in zip(tokens, rows) if not held(d)]
    c = Counter(w for x in learned for w in x)
    ranked = sorted((w for w in c if w != lm.END), key=lambda w: (-c[w], w))
    n = max((n for n in set(c.values()) if sum(v >= n for v in c.values()) > lm.HEAD), default=0)
    head, core = [w for w in ranked if c[w] > n], {w: i for i, w in enumerate([lm.END, *[w for w in ranked if c[w] > n][: lm.TYPES]])}
    group = lambda w: len(core) + zlib.crc32(w[-3:]) % lm.OTHER
    pairs = np.zeros((len(core) + lm.OTHER,) * 2)
    for x in learned:
        for a, b in zip([lm.END, *x], x):
            pairs[core.get(a, group(a)), core.get(b, group(b))] += 1
    first = lm.exchange(pairs, 0, lm.CLASSES)
    k, start = lm.CLASSES + 1, lambda w: first[core.get(w, group(w))]

    def smooth(joint):
        into = [(joint[:, b].sum() + 1) / (joint.sum() + k) for b in range(k)]
        return [[math.log10((joint[a, b] + 5 * into[b]) / (joint[a].sum() + 5)) for b in range(k)] for a in range(k)]

    def place(words, before):
        seen = {w: Counter() for w in words}
        for x in learned:
            for a, b in zip([lm.END, *x], x):
                if b in seen:
                    seen[b][before(a)] += 1
        fits = lambda w, to: sum(m * step[a][to] for a, m in seen[w].items()) - c[w] * math.log10(size[to] + c[w])
        return {w: max(range(k - 1), key=lambda to: (round(fits(w, to), 9), -to)) for w in words if c[w] >= lm.PLACED}

    joint = np.zeros((k, k))
    np.add.at(joint, (first[:, None], first[None, :]), pairs)
    step, size = smooth(joint), [pairs[:, first == i].sum() for i in range(k)]
    own = place([w for w in head if w not in core], start)
    before = lambda w: own.get(w, start(w))
    own = own | place([w for w in c if w not in core and w not in head], before) if (tail := set(c) - set(head) - set(core)) else own
    of = lambda w: own.get(w, start(w))
    after = lambda w: start(w) if w in tail or w not in c else of(w)
    joint = np.zeros((k, k))
    for x in learned:
        for a, b in zip([lm.END, *x], x):
            joint[after(a), of(b)] += 1
    step, words = smooth(joint), Counter(of(w) for w in c if w != lm.END)
    emit = lambda w: math.log10((c[w] + 1) / (joint[:, of(w)].sum() + words[of(w)] + 1))
    return [sum(step[after(a)][of(b)] + emit(b) for a, b in zip([lm.END, *x], x)) for x in tokens]


@pytest.mark.parametrize("head", [lm.HEAD, 60, 20])
def test_class_lm_against_brute_force(make, monkeypatch, head):
    for name, value in (("HEAD", head), ("TYPES", 10), ("CLASSES", 4)):
        monkeypatch.setattr(lm, name, value)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    rows = [(d, t if len(t or "") < 1000 else "a1 b2 " * 800) for d, t in lm_rows()]
    rows += [(1000 + i, f"c{i % 9} a{i % 50} rare{i} d{i % 17}") for i in range(80)]
    got = lm.score(make(rows), remainder("doc_id", 7) == 2).collect()
    want = Counter((d, round(s, 6)) for (d, _), s in zip(rows, brute_class_lm(rows, held)))
    assert Counter((r.doc_id, round(r.score, 6)) for r in got) == want


def test_class_lm_is_a_distribution():
    """Class transitions and emissions with one unseen word per class sum to one."""
    pairs = np.random.default_rng(0).integers(0, 9, (30, 30)).astype(float)
    of = lm.exchange(pairs, 0, classes=4)
    assert of[0] == 4 and set(of[1:]) <= set(range(4))
    member = np.eye(5)[of]
    joint = member.T @ pairs @ member

    def likelihood(of):
        m = np.eye(5)[of]
        j = m.T @ pairs @ m
        f = lm._xlogx
        return f(j).sum() - f(j.sum(0)).sum() - f(j.sum(1)).sum()

    start = np.zeros(30, int)
    start[1:] = np.arange(29) % 4
    start[0] = 4
    assert likelihood(of) >= likelihood(start)
    into = (joint.sum(0) + 1) / (joint.sum() + 5)
    assert np.allclose(((joint + 5 * into) / (joint.sum(1, keepdims=True) + 5)).sum(1), 1)


def mix_rows():
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 60), None, s) for i, s in enumerate(rng.choice(["a", "b", "c", "d", None, "hot", "hot"]) for _ in range(400))]
    return rows + [(900, None, None, "e"), (901, "x " * 50_000, None, "a"), (902, "x", None, "f"), (902, "x", None, "f"), (None, "y y", None, "a")]


@pytest.mark.parametrize("rows_per_slice", [4096, 16])
def test_mixing(make, monkeypatch, rows_per_slice):
    monkeypatch.setattr(mixing, "ROWS", rows_per_slice)
    rows = mix_rows()
    got = mixing.mix(make(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(make(rows)).collect()), key=repr)
    assert len(got) == len(rows)
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    budget, target, open_ = 1.5 * sum(size.values()), {}, set(size)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    source = {r[0]: r[3] for r in rows}
    taken, longest = Counter(), Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and math.isclose(r.target, target[s], rel_tol=1e-9)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    for s in size:
        assert abs(taken[s] - target[s]) <= longest[s] + 1
    assert sum(taken.values()) <= budget


def test_mixing_of_nothing(make):
    assert mixing.mix(make([])).collect() == []
    assert [r.taken for r in mixing.mix(make([(1, None), (2, "")])).collect()] == [0, 0]
