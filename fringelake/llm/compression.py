"""Quality rules from compression: texts that zstandard packs far better or far worse than prose of their length.

Repetitive text packs too well, random or encoded text hardly at all. Both show in the ratio of the whole text and of
fixed chunks, whose limits depend on the length, as short texts pack worse. Counts of words, symbols, repeated lines and
repeated windows of words come beside the verdict.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Limits of (bytes of the text) / (bytes packed) for lengths from `bytes` on: (bytes, least, most). Prose of European
#: languages lies between 1.3 and 1.8 at 300 bytes and between 2 and 3 from 4 kB on; random letters and digits at 1.3
#: and base64 at 1.32 at most. Below 128 bytes the packer's own header counts for too much for a least ratio.
LIMITS = ((0, 0.0, 3.2), (128, 1.0, 3.2), (512, 1.22, 3.6), (2048, 1.35, 4.0), (8192, 1.4, 4.5), (32768, 1.45, 5.0))
#: Bytes of a chunk; a last piece shorter than `LAST` is judged with the chunk before it.
CHUNK, LAST = 4096, 1024
#: A text goes if chunks beyond their limits hold more than this share of its bytes.
SHARE = 0.3
LEVEL = 3
#: Words of a window, least words of a text, and the percentage of words in repeated windows that is too much.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
#: A text is split into words in pieces of so many bytes.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_numbers(raw: bytes) -> np.ndarray:
    """The text's words as numbers, equal for equal words; holds the distinct words and a piece of the text."""
    numbers: dict[bytes, int] = {}
    found, at = [], 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + PIECE) if at + PIECE < len(raw) else None
        end = cut.start() if cut else len(raw)
        found.append(np.array([numbers.setdefault(w, len(numbers)) for w in raw[at:end].split()], dtype=np.int64))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.int64)


def repeated_words(words: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words found twice or more, by ranks of windows of 2, 4 and 8 words."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ranks, width = words, 1
    while width < WINDOW:
        pairs = ranks[:-width] * (int(ranks.max()) + 1) + ranks[width:]
        ranks = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    twice = np.bincount(ranks)[ranks] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + WINDOW, -1)
    return int((edges.cumsum() > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


class Bands:
    """Verdicts by compression ratio under limits by length."""

    def __init__(self, limits: tuple[tuple[int, float, float], ...] = LIMITS, chunk: int = CHUNK, share: float = SHARE, level: int = LEVEL):
        self.limits, self.chunk, self.share = sorted(limits), chunk, share
        self.last = min(LAST, chunk)
        self.packer = zstandard.ZstdCompressor(level=level)

    def ratio(self, raw: bytes) -> float:
        return len(raw) / len(self.packer.compress(raw)) if raw else 1.0

    def within(self, size: int, ratio: float) -> bool:
        low, high = next((a, b) for least, a, b in reversed(self.limits) if size >= least)
        return low <= ratio <= high

    def chunks(self, raw: bytes) -> Iterator[bytes]:
        """Chunks of equal size; what is left over at the end, if short, belongs to the last one."""
        at = 0
        while at < len(raw):
            end = at + self.chunk
            end = len(raw) if end + self.last > len(raw) else end
            yield raw[at:end]
            at = end

    def judge(self, raw: bytes) -> tuple[float, float, bool]:
        """Ratio of the whole text, the share of it in chunks beyond their limits, and whether it stays."""
        ratio = self.ratio(raw)
        odd = 0
        if len(raw) > self.chunk:
            odd = sum(len(c) for c in self.chunks(raw) if not self.within(len(c), self.ratio(c)))
        share = odd / max(len(raw), 1)
        return ratio, share, self.within(len(raw), ratio) and share <= self.share


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "odd_share"]


def quality(docs: DataFrame, **settings) -> DataFrame:
    """One row for each row of `docs` (doc_id, text) with its counts, `base_failed`, and whether it is `kept`.

    `settings` go to Bands: limits, chunk, share, level. A null text is an empty one: no words, base_failed. Very long
    texts are read whole, word by word in pieces and chunk by chunk. Rows that repeat are judged each by itself, so ties
    do not matter; null ids stay null; an empty table gives no rows; other columns are not read. No row is moved.
    """
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, odd_share double"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(**settings)
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                raw = text.encode()
                words = word_numbers(raw)
                n, again = len(words), repeated_words(words)
                failed = n < LEAST_WORDS or 100 * again > MOST_REPEATED * n
                ratio, share, stays = bands.judge(raw)
                count = lambda of, text=text: sum(map(text.count, of))
                rows.append((n, len(text) - count(SPACES), count(SYMBOLS), repeated_lines(text), again, failed, stays and not failed, ratio, share))
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=NAMES)

    return docs.select("doc_id", "text").mapInArrow(task, kind)
