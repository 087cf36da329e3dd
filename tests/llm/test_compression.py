"""Compression bands against plain counts, and what they reject."""

import random
import re

import pytest
import zstandard

from fringelake.llm import compression


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = text.split("\n")
    dups = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside), failed


def verdict(text):
    """The rule of the whole text and its chunks, written out."""
    raw = (text or "").encode()
    fits = lambda b: next(lo <= len(b) / max(len(zstandard.ZstdCompressor(level=3).compress(b)), 1) <= hi for least, lo, hi in compression.LIMITS[::-1] if len(b) >= least)
    if len(raw) <= 4096:
        return fits(raw) if raw else True
    cuts = list(range(0, len(raw), 4096))
    if len(raw) - cuts[-1] < 1024:
        cuts.pop()
    parts = [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
    return fits(raw) and sum(len(p) for p in parts if not fits(p)) <= 0.3 * len(raw)


def prose(rng, n):
    """Sentences of a made vocabulary with the skewed frequencies of prose."""
    syllables = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "u", "en", "er")]
    words = ["".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 2, 3]))) for _ in range(800)]
    return " ".join(words[min(int(rng.paretovariate(0.6)) - 1, 799)] + rng.choice(["", "", "", "", ",", ".\n"]) for _ in range(n))


def texts():
    rng = random.Random(4)
    base64 = lambda n: " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40)) for _ in range(n))
    long = prose(rng, 3000)
    good = [prose(rng, n) for n in (25, 60, 200, 800, 3000, 20_000)]
    bad = [base64(60), base64(400), "word " * 500, "\n".join(f"row {i % 7}" for i in range(900)), long + " " + base64(280), long + " ha" * 6000]
    odd = [None, "", " \n\t", "one", "a b c d e f g h i " * 3, "x\x0by\x0cz\r\n\x85 #$%&", "é𝄞 " * 30, "same line\nsame line\n\nsame line \n", " ".join(map(str, range(40))) * 2]
    return good, bad, odd


def test_counts_and_verdicts(spark, make):
    good, bad, odd = texts()
    rows = [(i, t) for i, t in enumerate([*good, *bad, *odd])] + [(3, good[3]), (None, good[1])]
    found = compression.quality(make(rows)).collect()
    assert len(found) == len(rows)
    text = dict(rows)
    for r in found:
        t = text[r.doc_id]
        assert tuple(r)[1:7] == plain(t)
        assert r.kept == (not r.base_failed and verdict(t)), r
    kept = {r.doc_id for r in found if r.kept}
    assert kept >= set(range(len(good))) and not kept & set(range(len(good), len(good) + len(bad)))


def test_what_the_counts_miss_is_rejected_by_compression():
    """Neither base64 nor short repeats of changing words fail the counts; the bands see them."""
    good, bad, _ = texts()
    bands = compression.Bands()
    assert all(bands.judge(t.encode())[2] for t in good)
    assert [bands.judge(t.encode())[2] for t in bad] == [False] * len(bad)
    assert not any(plain(t)[-1] for t in (bad[0], bad[1], bad[4]))
    assert compression.Bands(limits=((0, 0.0, 1e9),)).judge(bad[0].encode())[2]


def test_very_long_texts_are_read_whole(spark, make, monkeypatch):
    long = "alpha beta gamma " * 700_000
    (r,) = compression.quality(make([(1, long + "delta")])).collect()
    assert r.n_words == 2_100_001 and r.n_repeat_words == 2_100_000 and not r.kept
    monkeypatch.setattr(compression, "PIECE", 5)
    text = "a bb ccc\tdddd eeeee ffffff\n" * 9
    assert compression.word_numbers(text.encode()).tolist() == list(range(6)) * 9


def test_empty_tables(spark, make):
    assert compression.quality(make([(1, "a")]).limit(0)).collect() == []


@pytest.mark.parametrize("size", [4095, 4096, 4097, 5119, 5120, 8192, 9000])
def test_chunks_cover_the_text(size):
    raw = bytes(range(256)) * 40
    parts = list(compression.Bands().chunks(raw[:size]))
    assert b"".join(parts) == raw[:size] and all(len(p) >= 1024 for p in parts) and all(len(p) == 4096 for p in parts[:-1])
