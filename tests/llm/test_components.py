"""Components and near copies without rounds, jobs and links that were had before."""

import numpy as np
from fringelake.llm import near_copies, shared


def test_stars_are_known_without_a_round(spark, monkeypatch):
    written, write = [], shared.materialize
    monkeypatch.setattr(shared, "materialize", lambda df, tag, *by: (written.append(tag), write(df, tag, *by))[1])
    found = shared.connected_components(spark.createDataFrame([(1, 5), (6, 1), (5, 1), (2, 9), (3, 3)], "u long, v long"))
    assert {r.node: r.root for r in found.collect()} == {1: 1, 5: 1, 6: 1, 2: 2, 9: 2}
    assert written == ["edges", "least"]


def test_no_round_of_near_copies_joins_links_of_an_earlier_one(spark, monkeypatch):
    rng, seen, join = np.random.default_rng(0), [], near_copies.connected_components
    monkeypatch.setattr(near_copies, "PART", 1)  # shards are dealt in parts, so that several rounds find links
    monkeypatch.setattr(near_copies, "connected_components", lambda links: (seen.append({(r.u, r.v) for r in links.collect()}), join(links))[1])
    base, rows = [f"w{i}" for i in range(200)], []
    for k in range(60):  # drifting texts: neighbours are near, ends are not
        base[rng.integers(200)], base[rng.integers(200)] = f"x{k}", f"y{k}"
        rows.append((k, " ".join(base)))
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [near_copies.shingles(t.encode()) for _, t in rows]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(root))
    assert len(seen) > 1 and len(set().union(*seen)) == sum(map(len, seen))
