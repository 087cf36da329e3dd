import hashlib
import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fringelake.llm import ann, bpe, pii

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz" + "éßñ'ÀİΣςÅ \t\n\x1c\x85​ #$12٣一ﬁǅ"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    out += ["I'll we're it's THEY'VE", "<|endoftext|>x<|startoftext|> <|end", "aaaa" * 300, "ab" * 999, "".join(rng.choice("abcde") for _ in range(60_000)), "a\u1c89 \ua7da1 \U00010d51x \U00016ea0 a\u0c5c1 \U000323b0x", "the end. " * 20_000, "Å Å", " \n "]
    with open("/root/testdata/sf0.001/documents.parquet", "rb"):
        import pandas as pd

        out += pd.read_parquet("/root/testdata/sf0.001/documents.parquet")["text"].dropna().tolist()
    return out


def test_bpe_is_the_library(make):
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation(), tok.no_padding()
    rows = [*enumerate(texts()), (9000, None), (9001, ""), (3, "again"), (None, "null id")]
    got = bpe.encode(make(rows), PATH, with_ids=True).collect()
    assert len(got) == len(rows)
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded, r.decoded_sha256) for r in got)
    want = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        want.append((d if d is not None else -1, len(ids), tuple(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), decoded, hashlib.sha256(decoded.encode()).hexdigest()))
    assert found == sorted(want)


def test_every_token_encodes_to_itself():
    b = bpe.load(PATH)
    assert all(b.whole(t) for t in b.halves)


def test_bpe_with_small_caches(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    b, tok = bpe.Bpe(PATH), Tokenizer.from_file(PATH)
    for t in texts()[:60]:
        assert b.encode(t) == tok.encode(t, add_special_tokens=False).ids


def test_bpe_of_every_newer_letter():
    b, tok = bpe.Bpe(PATH), Tokenizer.from_file(PATH)
    for c in [*bpe.unassigned(), *bpe.SMALL, *(c for a, z in bpe.ADDED for c in range(a, z + 1))]:
        assert b.encode(f"a{chr(c)}1") == tok.encode(f"a{chr(c)}1", add_special_tokens=False).ids


def test_bpe_keeps_no_more_than_its_bounds(monkeypatch):
    monkeypatch.setattr(bpe, "PREFIXES", 50)
    b = bpe.Bpe(PATH)
    for t in texts()[:200]:
        b.encode(t)
    assert len(b._prefix) <= 51 + bpe.LONG
    b.forget()
    assert not any(map(len, (b._fits, *b._runs))) and b.encode("the end") == bpe.load(PATH).encode("the end")


def test_bpe_of_nothing(make):
    assert bpe.encode(make([]), PATH).collect() == []


def brute_nearest(rows, every, k):
    out = {}
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    for i, v in good:
        if i % every == 0:
            s = [(-float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), j) for j, w in good if j != i]
            out[i] = sorted((round(a, 12), j) for a, j in s)[:k]
    return out


def vectors(n=600, dims=16):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=dims).tolist()) for i in range(n)]
    same = rows[7][1]
    rows += [(n + i, same) for i in range(200)]
    return rows + [(5000, None), (5001, [0.0] * dims), (5002, [float("nan")] + [1.0] * (dims - 1)), (5050, [float("inf")] * dims), (5003, [None] + [1.0] * (dims - 1))]


@pytest.mark.parametrize("segment", [4096, 40])
def test_ann_recall_and_scores(spark, monkeypatch, segment):
    monkeypatch.setattr(ann, "SEGMENT", segment)
    rows = vectors()
    got = ann.nearest(spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, list int, cell int")).collect()
    want, hits = brute_nearest(rows, 50, 5), 0
    assert {r.query_id for r in got} == set(want)
    true = dict(rows)
    for q, best in want.items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        for r in mine:
            a, b = np.array(true[q]), np.array(true[r.vec_id])
            assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
        hits += len({r.vec_id for r in mine} & {j for _, j in best})
    assert hits >= 0.9 * 5 * len(want)


def test_adaptive_scan_keeps_the_nearest():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(3000, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    hits = 0
    for q in rows[:60]:
        at, _ = ann.scan(q, rows, 6)
        true = np.argsort(((rows - q) ** 2).sum(1))[:6]
        hits += len(set(true) & set(at))
        assert len(at) < 1500
    assert hits >= 0.97 * 360


def test_ann_of_few_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], kind)).collect() == []
    got = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], kind)).collect()
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]


def luhn(s):
    d = [int(c) for c in reversed(s) if c.isdigit()]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


SAID = {
    "card": "pay 4785380592391139 now", "spaced": "pay 4785 3805 9239 1139, ok", "bad": "no. 4785380592391138 stays", "ip": "at 42.144.35.254 here", "mail": "to ann.bee.42@mail8.example.com thanks",
    "phone": "call +1 (986) 555-4218.", "ssn": "is 665-12-0001 his", "date": "on 1999-02-28 born", "nodate": "on 1999-02-30 unborn", "pass": "password=b7db7aa4a5fcc78305 x", "token": 'token = "0641917ea4e9feb9cda83477b57ac2654884f485" y', "none": "nothing 12 here",
}


def test_pii(make):
    rows = [(i, t) for i, t in enumerate(SAID.values())]
    rows += [(100, None), (101, ""), (102, "x" * 300_000 + " 42.144.35.254"), (103, " ".join(SAID.values())), (4, SAID["mail"]), (104, "42.144.35.254 42.144.35.254\n1.2.3.4"), (None, SAID["ip"])]
    got = [(r.doc_id, r.text, r.n_replaced) for r in pii.pseudonymise(make(rows)).collect()]
    assert len(got) == len(rows)
    new = {d: (t, n) for d, t, n in got}
    of = {k: new[i] for i, k in enumerate(SAID)}
    for k in ("bad", "nodate", "none"):
        assert of[k] == (SAID[k], 0)
    shapes = {k: re.sub(r"[a-z]", "a", re.sub(r"\d", "9", SAID[k])) for k in ("card", "spaced", "phone", "ssn", "date")}
    for k, shape in shapes.items():
        text, n = of[k]
        assert n == 1 and text != SAID[k] and re.sub(r"[a-z]", "a", re.sub(r"\d", "9", text)) == shape
    assert luhn(of["card"][0]) and luhn(of["spaced"][0])
    assert re.sub(r"\D", "", of["card"][0]) == re.sub(r"\D", "", of["spaced"][0])
    assert all(0 <= int(x) <= 255 for x in of["ip"][0].split()[1].split("."))
    assert of["mail"][0].endswith(".com thanks") and "ann.bee.42" not in of["mail"][0] and "@mail8.example.com" in of["mail"][0]
    assert re.fullmatch(r"password=[0-9a-f]{18} x", of["pass"][0]) and of["pass"][0] != SAID["pass"]
    assert re.fullmatch(r'token = "[0-9a-f]{40}" y', of["token"][0])
    assert new[100] == (None, 0) and new[101] == ("", 0)
    assert new[103][0] == " ".join(t for t, _ in of.values())
    parts = new[104][0].split()
    assert parts[0] == parts[1] == of["ip"][0].split()[1] and new[104][1] == 3
    assert new[102][0].split()[1] == parts[0] and new[None][0] == of["ip"][0]


def test_pii_is_a_permutation(make):
    values = ["10.0.%d.%d" % (i // 200, i % 200) for i in range(600)]
    got = pii.pseudonymise(make([(i, v) for i, v in enumerate(values)])).collect()
    assert len({r.text for r in got}) == len(values)
    days = ["%d-%02d-%02d" % (y, m, d) for y in (1950, 2000) for m in range(1, 13) for d in range(1, 29)]
    got = pii.pseudonymise(make([(i, v) for i, v in enumerate(days)])).collect()
    assert len({r.text for r in got}) == len(days) and all(re.fullmatch(r"\d{4}-\d\d-\d\d", r.text) for r in got)


def test_pii_takes_any_area_code(make):
    said = ["+1 (%03d) %03d-%04d" % (a, e, a) for a in range(0, 1000, 9) for e in (17, 555)] + ["(017) 555-7713", "+1 136-555-7479", "+1.136.055.7479", "1 (136) 555-7479"]
    rows = [(i, "call %s." % v) for i, v in enumerate(said)] + [(5000, "136-555-7479 stays")]
    got = {r.doc_id: (r.text, r.n_replaced) for r in pii.pseudonymise(make(rows)).collect()}
    assert got.pop(5000) == ("136-555-7479 stays", 0)
    assert all(n == 1 and re.sub(r"\d", "9", got[i][0]) == re.sub(r"\d", "9", rows[i][1]) for i, (_, n) in got.items())
    assert len({t for t, _ in got.values()}) == len(said) and sum(got[i][0] != t for i, t in rows[:-1]) > 0.9 * len(said)


def test_pii_of_nothing(make):
    assert pii.pseudonymise(make([])).collect() == []


def test_vocabulary_is_not_in_the_repository():
    assert json.load(open(PATH))["model"]["type"] == "BPE"


def test_one_phone_number_is_one_pseudonym_in_every_format(make):
    rows = [(1, "call 986-555-4218"), (2, "call (986) 555-4218 now"), (3, "+1 986.555.4218"), (4, "1-986 555-4218"), (5, "(017) 555-7713")]
    got = {r.doc_id: r.text for r in pii.pseudonymise(make(rows)).collect()}
    digits = {d: re.sub(r"\D", "", t)[-10:] for d, t in got.items()}
    assert len({digits[d] for d in (1, 2, 3, 4)}) == 1 and digits[1] != "9865554218"
    for d, t in rows:
        assert re.sub(r"\d", "9", t) == re.sub(r"\d", "9", got[d])
    assert digits[1][0] in "23456789" and digits[1][3] in "23456789" and digits[5][0] in "01"


def test_addresses_of_many_labels_need_bounded_stack(make):
    text = "q a@b" + ".c1" * 30_000
    got = pii.pseudonymise(make([(1, text)])).first()
    assert got.text.endswith("@b" + ".c1" * 30_000) and got.n_replaced == 1 and len(got.text) == len(text)
