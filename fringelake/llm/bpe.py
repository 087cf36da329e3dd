"""BPE encoding by per-prefix dynamic programming over an automaton of the vocabulary."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept, returning_memory

#: Runs and words, together, that one generation of a worker's cache keeps, and prefixes of words, of which all are dropped together.
KEPT, PREFIXES, PAIRS = 100_000, 100_000, 150_000
#: Longer runs and words, in bytes, are worked out each time and not kept, so that what is kept is bounded in bytes too.
LONG = 64
#: Bits of a token and of a length in the packed state of a prefix.
TOKEN, SIZE = 20, 7
CONTROL = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable character for each byte: itself if it is visible Latin-1, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


#: Ranges of letters and numbers that Unicode 16 added to version 15.1, Python's own.
ADDED = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0),
    (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5F0), (0x1E5F1, 0x1E5FA),
)

#: Small letters of capitals that Unicode added after version 15.1.
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
CAPITAL = re.compile("[\u1c89\ua7cb\ua7cc\ua7ce\ua7d2\ua7d4\ua7da\ua7dc\U00010d50-\U00010d65\U00016ea0-\U00016eb8]")


@functools.cache
def unassigned() -> dict[int, str]:
    """Letters and numbers of Unicode versions after 16, each with a symbol in its place.

    The split pattern's classes come from a module with newer tables than the library's; there these points are symbols.
    """
    out = {}
    for plane in (0, 1, 2, 3):
        every = "".join(chr(c) for c in range(plane << 16, plane + 1 << 16) if not 0xD800 <= c < 0xE000)
        for m in regex.finditer(r"[\p{L}\p{N}]", every):
            c = ord(m.group())
            if unicodedata.category(chr(c)) == "Cn" and not any(a <= c <= z for a, z in ADDED):
                out[c] = "\xa4"
    return out


class Bpe:
    """A word-end BPE vocabulary file, its normaliser and its split pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.mark = 256 if self.end else 0
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.later = frozenset(map(chr, unassigned()))
        self.letters = byte_letters()
        vocab = model["vocab"]
        self.text_of = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.made = {vocab[a] << 20 | vocab[b]: vocab[a + b] for a, b in pairs}
        self.halves = {t: (p >> 20, p & 0xFFFFF) for p, t in self.made.items()}
        self.names = np.array([self.text_of.get(i, "") for i in range(max(self.text_of) + 1)], object)
        self.raw = {i: i.to_bytes(4, "little") for i in self.text_of}
        self._whole: dict[int, bool] = {}
        self._build(vocab)
        self.forget()

    def forget(self) -> None:
        """Drop what texts have left behind."""
        self._fits: dict[int, bool] = {}
        self._runs: list[dict[str, bytes]] = [{}, {}]
        #: prefix of a word -> its state, its last token + 1 and that token's length, packed
        self._prefix: dict[bytes, int] = {b"": 0}

    def _symbols(self, token: str) -> list[int]:
        """Bytes of a token, the last one plus 256 where the token has the word end."""
        last = bool(self.end) and token.endswith(self.end)
        out = [self.byte_of[c] for c in (token[: -len(self.end)] if last else token)]
        return [*out[:-1], out[-1] + 256] if last else out

    def _build(self, vocab: dict[str, int]) -> None:
        """The automaton: states are prefixes of tokens; each knows its longest suffix that is a state, and a token."""
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        goto, token, size, kids = {}, [-1], [0], [[]]
        for name, i in vocab.items():
            at, symbols = 0, self._symbols(name)
            for s in symbols:
                to = goto.get(at << 9 | s)
                if to is None:
                    to = goto[at << 9 | s] = len(token)
                    token.append(-1), size.append(0), kids.append([])
                    kids[at].append((s, to))
                at = to
            token[at], size[at] = i, len(symbols)
        link, above, below, queue = [0] * len(token), [0] * len(token), [0] * len(token), deque(to for _, to in kids[0])
        while queue:
            at = queue.popleft()
            # the nearest state that is a token, from this one on and from its suffixes
            below[at] = above[link[at]]
            above[at] = at if token[at] >= 0 else below[at]
            for s, to in kids[at]:
                back = link[at]
                while back and back << 9 | s not in goto:
                    back = link[back]
                found = goto.get(back << 9 | s, 0)
                link[to] = found if found != to else 0
                queue.append(to)
        self.goto, self.link, self.above, self.below, self.token, self.size = goto, link, above, below, token, size
        self.edges = len(goto)

    def fits(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether the merges leave `left` next to `right`: no earlier merge joins across the boundary.

        The last merges inside either token are undone one by one, the later first; at each step the two pieces that
        touch must not form a token of a lower rank than the merges undone so far.
        """
        a, b = left, right
        while True:
            joined = self.made.get(a << 20 | b)
            if joined is not None and joined < limit:
                return False
            # equal ids: the left copy was merged first, so the right one is undone first
            if a > b:
                if a not in self.halves:
                    return True
                limit, a = a, self.halves[a][1]
            else:
                if b not in self.halves:
                    return True
                limit, b = b + 1, self.halves[b][0]

    def whole(self, token: int) -> bool:
        """Whether the merges turn a token's own string into that one token."""
        if token not in self._whole:
            halves = self.halves.get(token)
            self._whole[token] = halves is None or (self.whole(halves[0]) and self.whole(halves[1]) and self.fits(*halves, limit=token))
        return self._whole[token]

    def _last(self, at: int, n: int, tail) -> tuple[int, int]:
        """(last token, its length) of a prefix of n bytes in state `at`; tail(k) is the last token of its first k."""
        fits, token, size, below = self._fits, self.token, self.size, self.below
        at = self.above[at]
        while at:
            here, long = token[at], size[at]
            if long == n:
                if self.whole(here):
                    return here, long
            else:
                before = tail(n - long)
                if before >= 0:
                    pair = before << TOKEN | here
                    good = fits.get(pair)
                    if good is None:
                        if len(fits) >= PAIRS:
                            fits.clear()
                        good = fits[pair] = self.whole(here) and self.fits(before, here)
                    if good:
                        return here, long
            at = below[at]
        return -1, 0

    def _step(self, at: int, symbol: int) -> int:
        goto, here = self.goto, at
        to = goto.get(at << 9 | symbol)
        if to is not None:
            return to
        while (to := goto.get(here << 9 | symbol)) is None:
            if not here:
                raise ValueError(f"no token for byte {symbol & 255}")
            here = self.link[here]
        if len(goto) < 3 * self.edges:
            goto[at << 9 | symbol] = to
        return to

    def word(self, word: str) -> list[int]:
        """The ids of one word: each prefix has one possible last token; back-pointers from the end give them all."""
        data = word.encode("utf-8")
        return self._short(data) if len(data) <= LONG else self._long(data)

    def _short(self, data: bytes) -> list[int]:
        """What a prefix's last token is depends on that prefix alone, so it is kept for other words that begin alike."""
        prefix, n = self._prefix, len(data) - 1
        if len(prefix) > PREFIXES:
            prefix.clear()
            prefix[b""] = 0
        goto, above, below, token, size, fits, mask = self.goto, self.above, self.below, self.token, self.size, self._fits, (1 << TOKEN) - 1
        k = n
        while (got := prefix.get(data[:k])) is None:
            k -= 1
        at, last, long = got >> TOKEN + SIZE, -1, 0
        for k in range(k + 1, n + 2):  # the steps of _step and _last, spelled out as most of the time is spent here
            symbol = data[k - 1] if k <= n else data[n] + self.mark
            to = goto.get(at << 9 | symbol)
            at = self._step(at, symbol) if to is None else to
            here, last, long = above[at], -1, 0
            while here:
                it, wide = token[here], size[here]
                if wide == k:
                    good = self.whole(it)
                elif before := prefix[data[: k - wide]] >> SIZE & mask:
                    pair = before - 1 << TOKEN | it
                    good = fits.get(pair)
                    if good is None:
                        if len(fits) >= PAIRS:
                            fits.clear()
                        good = fits[pair] = self.whole(it) and self.fits(before - 1, it)
                else:
                    good = False
                if good:
                    last, long = it, wide
                    break
                here = below[here]
            if k <= n:
                prefix[data[:k]] = (at << TOKEN | last + 1) << SIZE | long
        out, k = [last], n + 1 - long
        while k:
            got = prefix[data[:k]]
            out.append((got >> SIZE & mask) - 1)
            k -= got & (1 << SIZE) - 1
        return out[::-1]

    def _long(self, data: bytes) -> list[int]:
        """The same with arrays over the word's bytes: time and memory grow with its length and not with its square."""
        n, at = len(data), 0
        tails, sizes = array("i", [-1]), array("i", [0])
        for k in range(1, n + 1):
            at = self._step(at, data[k - 1] + (self.mark if k == n else 0))
            last, long = self._last(at, k, tails.__getitem__)
            tails.append(last), sizes.append(long)
        out = []
        while n:
            out.append(tails[n])
            n -= sizes[n]
        return out[::-1]

    def _kept(self, made: list[dict], key: str, make) -> bytes:
        """make(key), looked up first among the two generations kept; the older one goes when the younger is full."""
        young, old = made
        got = young.get(key)
        if got is None:
            got = old.get(key) or make(key)
            if len(key) <= LONG:
                if len(young) >= KEPT:
                    made[:] = young, old = {}, young
                young[key] = got
        return got

    def _word(self, word: str) -> bytes:
        raw = self.raw
        return b"".join([raw[i] for i in self.word(word)])

    def _split(self, text: str) -> list[str]:
        if text.isascii() or self.later.isdisjoint(text):
            return self.words.findall(text)
        return [text[m.start() : m.end()] for m in self.words.finditer(text.translate(unassigned()))]

    def _run(self, run: str) -> bytes:
        words = self._split(run)
        if len(words) == 1 and words[0] == run:
            return self._word(run)
        return b"".join([self._kept(self._runs, w, self._word) for w in words])

    def raw_ids(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        ids, at = [], 0
        for m in [*(self.split_special.finditer(text) if "<|" in text and self.split_special else ()), None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                flat = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3").lower()  # no final sigma
                if not flat.isascii() and CAPITAL.search(flat):
                    flat = flat.translate(SMALL)
                # str.split() also parts at U+001C to U+001F, which the file's pattern takes as symbols
                runs = self._split(flat) if CONTROL.search(flat) else flat.split()
                young = self._runs[0]
                for r in runs:
                    got = young.get(r)
                    if got is None:
                        got = self._kept(self._runs, r, self._run)
                        young = self._runs[0]
                    ids.append(got)
            if m:
                at = m.end()
                ids.append(self.raw[self.special[m.group()]])
        return b"".join(ids)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.raw_ids(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a vocabulary file without a decoder has it."""
        known = self.text_of
        return " ".join([known[i] for i in ids if i in known])


def load(path: str) -> Bpe:
    """One vocabulary per worker process, until it runs another function of this subpackage."""
    return kept(f"bpe {path}", lambda: Bpe(path))


def _encoded(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                rows = []
                for x in b.column(1):
                    ids = bpe.raw_ids(x.as_py() or "")
                    text = " ".join(bpe.names[np.frombuffer(ids, "<u4")].tolist())
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest(), *((np.frombuffer(ids, "<u4").astype(np.int32), text) if with_ids else ())))
                cols = list(zip(*rows))
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if with_ids else 4]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return run


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with `with_ids` also ids and decoded.

    Every whole text is normalised and split as the vocabulary file says, each word encoded by `Bpe.word`, and decoded
    again. Special tokens in a text are taken as such. Null counts as empty: 0 tokens and the digests of nothing. Rows
    are independent, so repeated rows, ties, other columns and empty tables need nothing special. Very long texts and
    words are read whole, in time and memory that grow with their length; a worker keeps the vocabulary, and caches
    bounded in bytes, for its next task of this function.
    """
    more = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(returning_memory(_encoded(path, with_ids), f"bpe {path}"), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
