"""Repair of conversations against a dynamic programme in Python, and the long form against the short one."""

import hashlib
import random
import re
import zlib

import pytest

from fringelake.llm import turns

BLANK = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit int, rows string, digest int, gone string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def plain(rows):
    """All that repair() returns of one conversation, by exhaustive relaxation over (place, roles read so far)."""
    rows = damaged(rows)
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "none")
        seen.add((role, text))
    best = {"": (0, "", ())}

    def offer(table, key, value):
        if key not in table or value < table[key]:
            table[key] = value

    def put(table):
        for _ in range(3):
            for key, (cost, audit, lines) in list(table.items()):
                letter = "a" if key == "u" else "u"
                offer(table, letter, (cost + 5, audit + "I", (*lines, "user:" if letter == "u" else "assistant:")))
        return table

    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for key, (cost, audit, lines) in put(dict(best)).items():
            offer(after, key, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault == "truncated" else 0
            legal = {"": "su", "s": "u", "u": "a", "a": "u"}[key]
            if role[:1] and role[:1] in legal:
                offer(after, role[:1], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
            for letter, name in (("u", "user"), ("a", "assistant")):
                if letter in legal:
                    offer(after, letter, (cost + 1 + extra, audit + "R", (*lines, f"{name}:{text}")))
        best = after
    put(best)
    cost, audit, lines = min(best[k] for k in ("", "a") if k in best)
    at = [t for t, _, _ in rows if t is not None]
    letters = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
    gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
    return (gaps, *[faults.count(c) for c in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, n_conv, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Why?", " ", "", None, "It is so.  \n", "a b c", " ", "endé!"]
    rows = []
    for conv in [None, *range(n_conv)]:
        for turn in range(rng.randrange(1, longest)):
            if rng.random() < 0.9:
                role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "unknown"])
                rows.append((conv, rng.choice([turn, turn, turn, None]), role, rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.randrange(99)}{rng.choice(['.', ''])}"))
    return rows + rows[:7]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], SCHEMA).repartition(3)


def held(found):
    return {r.conv_id: tuple(r)[1:] for r in found.collect()}


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    return {k: plain(v) for k, v in by.items()}


@pytest.mark.parametrize("segment", [None, 1])
def test_every_conversation_is_repaired_as_by_the_plain_programme(spark, segment):
    rows = made(5, 60, 14)
    assert held(turns.repair(frame(spark, rows), segment)) == expected(rows)


def test_a_long_conversation_is_folded_in_segments(spark, monkeypatch):
    monkeypatch.setattr(turns, "SEGMENT", 7)
    rows = [(1, t % 90 if t < 100 else t, ("user", "assistant", "user")[t % 3], f"Turn {t % 40}{'.' * (t % 4 > 0)}") for t in range(260)]
    rows += [(1, 300, "user", "Again.")] * 30 + made(6, 5, 30)
    assert held(turns.repair(frame(spark, rows))) == expected(rows)


def test_empty_tables_and_conversations_of_which_nothing_is_left(spark):
    assert turns.repair(frame(spark, [(1, 1, "user", "x")]).limit(0)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    for segment in (None, 0.5):
        (row,) = turns.repair(frame(spark, [(gone, 1, "user", "Hello.")]), segment).collect()
        assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_very_long_texts_are_read_whole(spark):
    conv = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (1, 2)))
    rows = [(conv, 1, "user", "word " * 200_000 + "?"), (conv, 2, "assistant", "word " * 200_000)]
    assert held(turns.repair(frame(spark, rows))) == expected(rows)
