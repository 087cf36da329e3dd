"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import returning_memory

#: Buckets that character n-grams of 1 to 3 are hashed into.
BUCKETS = 1 << 16
#: Documents that the weights are fitted on at most, dealt evenly over the languages, but EACH of any language
#: (the documented bound). Every language is learned; the driver holds about 0.6 MB of weights for one.
SAMPLE, EACH = 2400, 24
#: Characters worked on at a time.
STEP = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of the lower-cased letters of a text; any run of other characters counts as one space.

    Whole texts are read in steps that overlap by two characters. A text without a letter yields nothing.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return
    codes = np.where(letter, codes, 32).astype(np.uint32)
    codes = np.concatenate([[32], codes[letter | np.concatenate([[True], letter[:-1]])], [32]]).astype(np.uint32)
    for at in range(0, len(codes) - 2, STEP):
        c = codes[at : at + STEP + 2]
        h1 = c * np.uint32(0x9E3779B1)
        h2 = (h1[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        h3 = (h2[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        end = len(h3)
        yield np.concatenate([h1[:end], h2[:end], h3]) >> np.uint32(16)


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets present in a text and how often."""
    total: np.ndarray | None = None
    for g in grams(text):
        n = np.bincount(g, minlength=BUCKETS)
        total = n if total is None else total + n
    at = np.flatnonzero(total) if total is not None else np.zeros(0, np.int64)
    return at, total[at] if total is not None else at


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for x in b.column(0):
            got = [np.bincount(g, minlength=BUCKETS) > 0 for g in grams(x.as_py())]
            if got:
                held += functools.reduce(np.logical_or, got)
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["bucket", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            got = [_counts(x.as_py()) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([g[0].astype(np.uint16).tobytes() for g in got]), pa.array([np.minimum(g[1], 65535).astype(np.uint16).tobytes() for g in got])], ["lang", "order", "at", "n"]
            )


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, l1: float, l2: float, alpha: float = 0.5, beta: float = 1.0, epochs: int = 4) -> np.ndarray:
    """Weights (buckets + 1, classes) by follow-the-regularised-leader with elastic-net penalties; the last is a bias."""
    z, n = np.zeros((BUCKETS + 1, classes), np.float32), np.zeros((BUCKETS + 1, classes), np.float32)

    def weights(at):
        return np.where(np.abs(z[at]) > l1, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            p = _softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on rows that the weights were not fitted on."""
    if not len(labels):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE, l1: float = 0.05, l2: float = 0.1) -> tuple[list[str], np.ndarray, float]:
    """(languages, weights times inverse document frequency, temperature), learned from rows where `learn` holds.

    Document frequencies are of all those rows. Weights are fitted on at most `sample` of them, or EACH of any language
    where there are many, the first by a hash of the id, and the temperature on every fifth of these, left out of the fit.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)).alias("order"))
    sizes = rows.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return [], np.zeros((BUCKETS + 1, 0)), 1.0
    total = sum(r["count"] for r in sizes)
    freq = np.zeros(BUCKETS)
    for r in rows.select("text").mapInArrow(returning_memory(_document_frequencies), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        freq[r.bucket] = r.n
    idf = np.log((1 + total) / (1 + freq)) + 1
    each = max(EACH, sample // len(langs))
    # of each language a share of the hash range that holds somewhat more than `each` rows, of which the first are taken
    shares = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 1.5 * each / r["count"]))))
    chosen = rows.where(F.col("order").cast("double") / 2.0**64 + 0.5 < F.element_at(shares, F.col("lang")))
    got = chosen.select("lang", "text", "order").mapInArrow(returning_memory(_features), "lang string, order long, at binary, n binary").toArrow().sort_by([("order", "ascending"), ("lang", "ascending")])
    index = {x: i for i, x in enumerate(langs)}
    x, y, per = [], [], np.zeros(len(langs), int)
    for lang, at, n in zip(got["lang"], got["at"], got["n"]):
        k = index[lang.as_py()]
        per[k] += 1
        if per[k] > each or not at.as_py():
            continue
        a, c = np.frombuffer(at.as_py(), np.uint16).astype(np.int64), np.frombuffer(n.as_py(), np.uint16).astype(float)
        x.append((np.append(a, BUCKETS), np.append(c / c.sum() * idf[a] * SCALE, 1.0)))
        y.append(k)
    y = np.array(y, int)
    held = np.arange(len(y)) % 5 == 4
    if not (~held).any():
        return [], np.zeros((BUCKETS + 1, 0)), 1.0
    w = ftrl([r for r, h in zip(x, held) if not h], y[~held], len(langs), l1, l2)
    t = temperature(np.array([v @ w[a] for (a, v), h in zip(x, held) if h]).reshape(-1, len(langs)), y[held])
    w[:-1] *= (idf * SCALE)[:, None]
    return langs, w, t


#: Relative frequencies are small; this puts them on the scale of the learning rate.
SCALE = 10.0


def _predictor(model):
    """An Arrow function of the text alone: the language and its score. Other columns stay in the JVM."""

    def predicted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs, w, t = model.value
        table, bias = np.ascontiguousarray(w[:-1], np.float32), w[-1]
        for text in texts:
            out, score = [], np.zeros(len(text))
            for i, x in enumerate(text):
                total, n = 0.0, 0
                for g in grams(x.as_py() or ""):
                    total, n = total + table.take(g, axis=0).sum(axis=0, dtype=np.float64), n + len(g)
                if not n or not langs:
                    out.append("und")
                    continue
                p = _softmax((total / n + bias) / t)
                out.append(langs[int(p.argmax())])
                score[i] = p.max()
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(score)], ["lang_pred", "score"])

    return F.arrow_udf(returning_memory(predicted), "struct<lang_pred: string, score: double>").asNondeterministic()  # so that a filter on the result is not pushed below it, to score each text twice


def identify(docs: DataFrame, held_out: Column, **settings) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (calibrated probability of lang_pred).

    Learns from rows with a language where `held_out` is false; predictions see the text alone, whole however long. A
    text that is null, empty or without a letter is `und` with score 0, as is every text if nothing can be learned (an
    empty table, no languages). Rows are scored one by one, so ties, repeated rows and other columns change nothing.
    """
    return with_language(docs.select("doc_id", held_out.alias("held_out"), "text", "lang"), F.col("held_out"), **settings).select("doc_id", "held_out", "lang_pred", "score")


def with_language(docs: DataFrame, held_out: Column, **settings) -> DataFrame:
    """Every row of `docs`, all columns, with lang_pred and score as `identify` gives them.

    Texts alone go to the workers, and only what is found comes back; nothing is joined and nothing shuffled. Columns
    named like the two new ones are replaced; nulls, empty tables and repeated rows are as in `identify`.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, ~held_out, **settings))
    rest = docs.drop("lang_pred", "score")
    found = rest.withColumn("__found", _predictor(model)(F.col("text")))
    return found.select(*rest.columns, F.col("__found.lang_pred").alias("lang_pred"), F.col("__found.score").alias("score"))
