"""Toxicity: a logistic classifier with a counterfactual penalty on identity terms."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the weights are fitted on at most (the documented bound).
SAMPLE = 16_000
#: Features in fewer sampled documents than this are not learned.
LEAST = 4
#: Features that the classifier weighs at most.
SCREENED = 20_000
#: Words that name groups of people, by language and kind; a word is swapped for the others of its row.
IDENTITY = (
    "muslim christian jewish hindu buddhist sikh catholic atheist",
    "muslims christians jews hindus buddhists sikhs catholics atheists",
    "african asian european american arab mexican indian chinese",
    "africans asians europeans americans arabs mexicans indians",
    "woman man girl boy female male transgender nonbinary",
    "women men girls boys females males",
    "gay lesbian straight bisexual queer heterosexual homosexual",
    "young old elderly teenage",
    "musulman chr\u00e9tien juif hindou bouddhiste catholique ath\u00e9e",
    "musulmans chr\u00e9tiens juifs hindous bouddhistes catholiques ath\u00e9es",
    "africain asiatique europ\u00e9en am\u00e9ricain arabe mexicain indien chinois",
    "femme homme fille gar\u00e7on",
    "femmes hommes filles gar\u00e7ons",
    "homosexuel lesbienne bisexuel h\u00e9t\u00e9rosexuel transgenre",
    "muslime christen juden hindus buddhisten katholiken atheisten",
    "muslimisch christlich j\u00fcdisch hinduistisch buddhistisch katholisch",
    "afrikaner asiaten europ\u00e4er amerikaner araber mexikaner inder chinesen",
    "frau mann m\u00e4dchen junge",
    "frauen m\u00e4nner",
    "schwul lesbisch bisexuell heterosexuell queer",
    "musulm\u00e1n cristiano jud\u00edo hind\u00fa budista cat\u00f3lico ateo",
    "musulmanes cristianos jud\u00edos hind\u00faes budistas cat\u00f3licos ateos",
    "africano asi\u00e1tico europeo americano \u00e1rabe mexicano indio chino",
    "mujer hombre ni\u00f1a ni\u00f1o",
    "mujeres hombres ni\u00f1as ni\u00f1os",
    "homosexual lesbiana bisexual heterosexual transg\u00e9nero",
)


def peers(identity: tuple[str, ...]) -> dict[str, list[str]]:
    """For each term the others of its row; a term of several rows keeps those of the first."""
    out: dict[str, list[str]] = {}
    for row in identity:
        words = row.split()
        for w in words:
            out.setdefault(w, [x for x in words if x != w])
    return out


WORDS = re.compile(r"[^\W\d_]+")


def features(words: set[str]) -> set[str]:
    """Words, and the first four and five letters of longer ones, so that inflected forms share what is learned."""
    return words | {w[:4] + "-" for w in words if len(w) > 5} | {w[:5] + "-" for w in words if len(w) > 6}


def _hashed(found: set[str]) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(f.encode("utf-8", "surrogatepass")) for f in found), np.uint32, len(found)))


def _sampled(identity: tuple[str, ...]):
    """Hashed features of each text, and of the text with each identity term swapped for a peer."""
    others = peers(identity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, rows = b.slice(at, 256), []
                for x, order in zip(part.column(1), part.column(2)):
                    words = set(WORDS.findall((x.as_py() or "").lower()))
                    swaps = []
                    for term in sorted(words & others.keys()):
                        peer = others[term][order.as_py() % len(others[term])]
                        swaps.append(_hashed(features(words - {term} | {peer})).tobytes())
                    rows.append((_hashed(features(words)).tobytes(), swaps))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))], ["toxic", "order", "own", "swaps"])

    return run


def _csr(rows: list[np.ndarray], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each entry whose feature is among `names` (sorted)."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.searchsorted(names, flat)
    ok = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == flat) if len(names) else np.zeros(len(flat), bool)
    return row[ok], at[ok]


def train(own: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[int, np.ndarray]], penalty: float = 1.0, l1: float = 1e-3, l2: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature hashes, weights, bias) by proximal accelerated gradient steps.

    The loss is the mean log loss, plus `penalty` times the mean squared change of the log odds when an identity term
    is swapped, plus an elastic net that leaves most weights at zero; its `l1` is larger for small samples. Only the
    SCREENED features with the steepest slope at the base rate are weighed.
    """
    every, df = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint32), np.zeros(0, int))
    names = every[df >= LEAST]
    n, d = len(own), len(names)
    row, col = _csr(own, names)
    if d > SCREENED:
        slope = np.abs(np.bincount(col, labels[row] - labels.mean(), d))
        names = names[slope >= np.partition(slope, d - SCREENED)[d - SCREENED]]
        d, (row, col) = len(names), _csr(own, names)
    l1 = max(l1, 0.05 / np.sqrt(max(1, n)))
    srow, scol = _csr([s for _, s in swaps], names)
    base = np.array([i for i, _ in swaps], int)
    w, b = np.zeros(d), 0.0
    if not n or labels.min() == labels.max():
        return names[:0], w[:0], float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5))) if n else -4.0
    y, look, tk = labels.astype(float), (w, b), 1.0

    def pulls(z, v):
        """Gradient in the weights of the counterfactual penalty, of the margins z and weights v."""
        if not len(base):
            return 0.0
        delta = (z[base] - np.bincount(srow, v[scol], len(base))) * (2 * penalty / len(base))
        return np.bincount(col, np.bincount(base, delta, n)[row], d) - np.bincount(scol, delta[srow], d)

    # the largest curvature, by power iteration, bounds the step
    v, vb, most = np.ones(d), 1.0, 1.0
    for _ in range(25):
        most = np.sqrt(v @ v + vb * vb)
        v, vb = v / most, vb / most
        z = np.bincount(row, v[col], n)
        v, vb = np.bincount(col, ((z + vb) * (0.25 / n))[row], d) + pulls(z, v), float((z + vb).mean() * 0.25)
    rate = 1 / (1.2 * np.sqrt(v @ v + vb * vb) + l2)
    for _ in range(steps):
        lw, lb = look
        z = np.bincount(row, lw[col], n)
        g = (1 / (1 + np.exp(-np.clip(z + lb, -50, 50))) - y) / n
        step = lw - rate * (np.bincount(col, g[row], d) + l2 * lw + pulls(z, lw))
        w2, b2 = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0), lb - rate * g.sum()
        if (lw - w2) @ (w2 - w) + (lb - b2) * (b2 - b) > 0:  # the momentum points uphill: start it anew
            tk = 1.0
        t2 = (1 + np.sqrt(1 + 4 * tk * tk)) / 2
        look = (w2 + (tk - 1) / t2 * (w2 - w), b2 + (tk - 1) / t2 * (b2 - b))
        w, b, tk = w2, b2, t2
    some = w != 0
    return names[some], w[some], float(b)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, identity: tuple[str, ...] = IDENTITY, **settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights learned from at most `sample` labelled documents where `learn` (of doc_id) holds.

    Several labels of one document count as toxic if any does. The sample's ids are bounded, so they are broadcast and
    the documents are scanned once.
    """
    rows = labels.where(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(23))
    total = rows.count()
    chosen = rows.withColumn("order", F.abs(F.shiftright(order, 1))).where(order.cast("double") / 2.0**64 + 0.5 < sample / max(1, total)) if total > sample else rows.withColumn("order", F.abs(F.shiftright(order, 1)))
    ids = chosen.orderBy("order", "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("toxic", F.col("text"), "order")
    got = found.mapInArrow(_sampled(identity), "toxic int, order long, own binary, swaps array<binary>").toArrow().sort_by([("order", "ascending")])
    own, swaps = [], []
    for i, (x, s) in enumerate(zip(got["own"], got["swaps"])):
        own.append(np.frombuffer(x.as_py(), np.uint32))
        swaps += [(i, np.frombuffer(c, np.uint32)) for c in s.as_py()]
    return train(own, np.array(got["toxic"].to_pylist(), int), swaps, **settings)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, bias = model.value
        weight = defaultdict(float, zip(names.tolist(), weights.tolist()))
        known: dict[str, float] = {}
        for b in batches:
            z = np.full(b.num_rows, bias)
            for i, x in enumerate(b.column(2)):
                found = features(set(WORDS.findall((x.as_py() or "").lower())))
                if len(known) > 400_000:
                    known.clear()
                total = 0.0
                for f in found:
                    v = known.get(f)
                    if v is None:
                        v = known[f] = weight.get(zlib.crc32(f.encode("utf-8", "surrogatepass")), 0.0)
                    total += v
                z[i] += total
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, **settings) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from `threshold` on).

    Scores come from words of the whole text alone, however long. Null and empty texts get the score of no words. If no label can be
    learned from (empty tables, one class only) every text gets the base rate. `identity` rows of terms are swapped for
    each other in the sample, and `penalty` weighs how much that may change a score. Labels without a document, null labels
    and other columns are ignored; repeated rows score alike.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, ~held_out, **settings))
    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", held_out.alias("held_out"), F.col("text")).mapInArrow(_scored(model), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
