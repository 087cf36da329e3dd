"""Language-model scoring with Brown class-based n-grams."""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, release

#: Token that ends each text; no word can hold a space.
END = b"\n"
#: Words at most that every worker holds with class and count (a few MB, broadcast); all others are joined.
HEAD = 1 << 17
#: Word types from which exchange clustering makes the classes, the most frequent; all other words are placed into these
#: classes by the classes before them, and until then, or if seen less than PLACED times, by one of OTHER groups of last letters.
TYPES, OTHER, PLACED = 512, 128, 4
#: Classes of the exchange clustering, with one more for the end.
CLASSES = 48
#: Distinct words that a task counts before it hands them on.
FLUSH = 400_000


def _tokens(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, and one end."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for b in batches:
        for x in b.column(0):
            held.update(_tokens(x.as_py()))
            if len(held) > FLUSH:
                yield out()
                held.clear()
    if held:
        yield out()


class Typed(dict):
    """Word -> its own number in the head, else that of its group by the last three bytes. Bounded memory."""

    def __init__(self, own: dict[bytes, int]):
        super().__init__(own)
        self.own = own

    def __missing__(self, word: bytes) -> int:
        if len(self) > FLUSH + len(self.own):
            self.clear()
            self.update(self.own)
        kind = self[word] = len(self.own) + zlib.crc32(word[-3:]) % OTHER
        return kind


def _numbered(shared):
    """Each text as the numbers of its tokens (32 bits each), and its words outside the head, parted by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        typed, top = Typed(own), len(own)
        for b in batches:
            numbers, rare = [], []
            for x in b.column(3):
                tokens = _tokens(x.as_py())
                at = np.fromiter(map(typed.__getitem__, tokens), np.int32, len(tokens))
                numbers.append(at.tobytes())
                rare.append(b" ".join(map(tokens.__getitem__, np.flatnonzero(at >= top).tolist())))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(numbers, pa.binary()), pa.array(rare, pa.binary())], ["rid", "doc_id", "held_out", "numbers", "rare"])

    return run


def _flat(numbers: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all tokens of a batch, where each text starts); as every text ends with an end, it also stands before the next."""
    bounds = np.frombuffer(numbers.buffers()[1], np.int32)[numbers.offset : numbers.offset + len(numbers) + 1]
    flat = np.frombuffer(numbers.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(np.int32)
    return flat, (bounds[:-1] - bounds[0]) // 4


def _with_before(flat: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What `of` gives for the token before each, the end (number 0) for the first, and for each itself."""
    here = of[flat]
    return np.concatenate([of[:1], here[:-1]]), here


def _pairs(shared):
    """Counts of adjacent types, the end standing before the first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = shared.value
        n = int(kinds.max()) + 1
        held = np.zeros(n * n, np.int64)
        for b in batches:
            if b.num_rows:
                before, here = _with_before(_flat(b.column(0))[0], kinds)
                np.add.at(held, before * n + here, 1)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["pair", "n"])

    return run


def _befores(shared):
    """How often each class stands before each word of the head that exchange has not classed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, types, top = shared.value
        held, waiting, k = [], 0, CLASSES + 1

        def out():
            at, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(at // k), pa.array(at % k, pa.int32()), pa.array(n)], ["word", "before", "n"])

        for b in batches:
            if b.num_rows:
                flat = _flat(b.column(0))[0]
                mine = (flat >= types) & (flat < top)
                held.append(flat[mine].astype(np.int64) * k + _with_before(flat, classes)[0][mine])
                waiting += len(held[-1])
                if waiting > 10 * FLUSH:
                    yield out()
                    held, waiting = [], 0
        if held:
            yield out()

    return run


def _transitions(shared):
    """Counts of adjacent classes within the head (word null, before * classes + class) and of each class before each other word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, top = shared.value
        k, names = CLASSES + 1, ["word", "before", "n"]
        joint, held = np.zeros(k * k, np.int64), Counter()

        def out():
            words, befores = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(befores, pa.int32()), pa.array(held.values(), pa.int64())], names)

        for b in batches:
            if not b.num_rows:
                continue
            flat = _flat(b.column(0))[0]
            before, here = _with_before(flat, classes)
            rare = flat >= top
            joint += np.bincount((before * k + here)[~rare], minlength=k * k)
            words = b" ".join(x for x in b.column(1).to_pylist() if x).split(b" ")
            befores = before[rare].tolist()
            for at in range(0, len(befores), FLUSH):
                held.update(zip(words[at : at + FLUSH], befores[at : at + FLUSH]))
                if len(held) > FLUSH:
                    yield out()
                    held.clear()
        if held:
            yield out()
        at = np.flatnonzero(joint)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(joint[at])], names)

    return run


def _placed(shared):
    """The class of each word under which it is likeliest after the classes `befores` that it follows in the corpus.

    The likelihood is that of the class given the one before, times that of the word in the class. Words seen less than
    PLACED times take the class of their group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, sizes, groups = shared.value
        k = CLASSES + 1
        for b in batches:
            if not b.num_rows:
                continue
            befores = b.column("befores")
            each = befores.flatten()
            row = np.repeat(np.arange(b.num_rows), befores.value_lengths().to_numpy(zero_copy_only=False))
            seen = np.bincount(row * k + each.field("before").to_numpy(), each.field("n").to_numpy(), b.num_rows * k).reshape(-1, k)
            c = b.column("c").to_numpy()
            of = np.argmax((seen @ step)[:, :CLASSES] - c[:, None] * np.log10(sizes[:CLASSES] + c[:, None]), axis=1).astype(np.int32)
            if groups is not None:
                for i in np.flatnonzero(c < PLACED):
                    of[i] = groups[zlib.crc32(b.column("word")[int(i)].as_py()[-3:]) % OTHER]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(of), befores], ["word", "c", "class", "befores"])

    return run


def _place(seen: DataFrame, kind: str, *model) -> DataFrame:
    """(word, c, class, befores) from how often each class stands `before` each word."""
    words = seen.groupBy("word").agg(F.sum("n").alias("c"), F.collect_list(F.struct("before", "n")).alias("befores"))
    return words.mapInArrow(_placed(seen.sparkSession.sparkContext.broadcast(model)), f"word {kind}, c long, class int, befores array<struct<before: int, n: long>>")


def _steps(joint: np.ndarray) -> np.ndarray:
    """log10 of the probability of each class after each, smoothed towards the class frequencies."""
    into = (joint.sum(0) + 1) / (joint.sum() + len(joint))
    return np.log10((joint + 5 * into) / (joint.sum(1, keepdims=True) + 5))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, fixed: int, classes: int = CLASSES, sweeps: int = 8) -> np.ndarray:
    """A class for each type: each type in turn moves to the class that gives the class bigrams most likelihood.

    `pairs[a, b]` counts type b after type a. The type `fixed` has a class of its own, the last.
    """
    n = len(pairs)
    order = [i for i in np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable") if i != fixed]
    of = np.zeros(n, int)
    of[order] = np.arange(n - 1) % classes
    of[fixed] = classes
    k = classes + 1
    member = np.eye(k)[of]
    right, left = pairs @ member, pairs.T @ member  # counts of each type before and after each class
    joint = member.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, own = of[w], pairs[w, w]
            right[:, a] -= pairs[:, w]
            left[:, a] -= pairs[w, :]
            r, c = right[w].copy(), left[w].copy()
            joint[a, :] -= r
            joint[:, a] -= c
            joint[a, a] -= own
            with_row, with_col = joint + r, joint + c[:, None]
            gain = (_xlogx(with_row) - _xlogx(joint)).sum(1) + (_xlogx(with_col) - _xlogx(joint)).sum(0)
            d = np.diag(joint)
            gain += _xlogx(d + r + c + own) + _xlogx(d) - _xlogx(d + r) - _xlogx(d + c)
            # totals with the type's pairs, which go to its neighbours' classes wherever it moves, and then to its own
            out, into = joint.sum(1) + c, joint.sum(0) + r
            gain -= _xlogx(out + r.sum() + own) - _xlogx(out) + _xlogx(into + c.sum() + own) - _xlogx(into)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            of[w] = b
            right[:, b] += pairs[:, w]
            left[:, b] += pairs[w, :]
            joint[b, :] += r
            joint[:, b] += c
            joint[b, b] += own
        if not moved:
            break
    return of


def _scores(shared):
    """A row per text with the sums over its head words, and a row per distinct other word of it and class before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, classes, step, spread, top = shared.value
        names = ["rid", "word", "before", "own", "n", "doc"]
        doc = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("rest", pa.float64())])
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                flat, starts = _flat(b.column(3))
                before, here = _with_before(flat, classes)
                rare = flat >= top
                rest = np.add.reduceat(np.where(rare, 0, step[before, here] - spread[here]), starts)
                log, known = np.add.reduceat(logs[flat], starts), np.add.reduceat((logs[flat] > 0).astype(np.int64), starts)
                length = np.diff(np.append(starts, len(flat)))
                docs = pa.StructArray.from_arrays([b.column(1), b.column(2), pa.array(length, pa.int64()), pa.array(known), pa.array(log), pa.array(rest)], fields=list(doc))
                rids, n = b.column(0).to_pylist(), b.num_rows
                zeros = pa.array(np.zeros(n, np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b" %d" % rid for rid in rids], pa.binary()), zeros, zeros, zeros.cast(pa.int64()), docs], names)
                befores, owns, at, rows, counted = before[rare].tolist(), here[rare].tolist(), 0, [], []
                for rid, words in zip(rids, b.column(4).to_pylist()):
                    if words:
                        words = words.split(b" ")
                        upto = at + len(words)
                        tail = Counter(zip(words, befores[at:upto], owns[at:upto]))
                        rows += [rid] * len(tail)
                        counted += tail.items()
                        at = upto
                if rows:
                    keys, ns = zip(*counted)
                    words, before_, own_ = zip(*keys)
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(words, pa.binary()), pa.array(before_, pa.int32()), pa.array(own_, pa.int32()), pa.array(ns, pa.int64()), pa.nulls(len(rows), doc)], names)

    return run


def _constants(values: np.ndarray) -> Column:
    """A column holding a bounded array of numbers, folded into the plan once."""
    return F.from_json(F.lit(json.dumps(values.ravel().tolist())), "array<double>")


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words (A-Z lower-cased, parted at the six ASCII spaces) and one end per text. Counts are of all tokens
    of all rows where `held_out` is false. base_score is the add-one unigram log10 probability. The model gives a token
    P(its class | class before) P(token | its class). Exchange clustering of the TYPES most frequent words, and of
    groups of the others by their endings, makes the classes; then every other word seen PLACED times or more is
    placed by itself into the class that makes it likeliest after the classes before it, however many words there are.
    Transitions are smoothed towards the class frequencies; emissions are add-one with one unseen word per class.

    The most frequent words go to the workers, at most HEAD of them, which write each text once as numbers of words; all
    later passes read these. The others are joined with their counts and
    classes, and as the word before another they stand for their group. Null and empty texts are one end. Repeated rows
    are scored each by itself; a null doc_id is kept. With nothing to learn from, all counts are 0. An empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession.sparkContext
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    learned = texts.where("not held_out").select("text")
    counts = materialize(learned.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    # the least count of which so few words have as many that all of them can be held by every worker
    least, held = 1, 0
    for n, words in counts.groupBy("n").agg(F.count("*")).orderBy(F.desc("n")).toLocalIterator():
        if held + words > HEAD:
            least = n + 1
            break
        held += words
    head = {bytes(r.word): r.n for r in counts.where((F.col("n") >= least) | (F.col("word") == F.lit(END))).collect()}
    ends = head.pop(END, 0)
    release(counts)
    ranked = [END, *sorted(head, key=lambda w: (-head[w], w))]
    own = {w: i for i, w in enumerate(ranked)}
    types, k = min(len(own), TYPES + 1), CLASSES + 1
    groups = np.array([types + zlib.crc32(w[-3:]) % OTHER for w in ranked[types:]], np.int64)
    kinds = np.concatenate([np.arange(types), groups, types + np.arange(OTHER)])

    n = types + OTHER
    pairs = np.zeros(n * n)
    texts = materialize(texts.mapInArrow(_numbered(spark.broadcast(own)), "rid long, doc_id long, held_out boolean, numbers binary, rare binary"), "numbered")
    learned, top = texts.where("not held_out").select("numbers", "rare"), len(own)
    got = learned.select("numbers").mapInArrow(_pairs(spark.broadcast(kinds)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs[got["pair"].to_numpy()] = got["n"].to_numpy()
    pairs = pairs.reshape(n, n)
    of = exchange(pairs, 0, CLASSES)
    member = np.eye(k)[of]
    step, sizes = _steps(member.T @ pairs @ member), member.T @ pairs.sum(0)

    # all other words: those of the head first, as they stand before others
    classes = of[kinds]
    seen = learned.select("numbers").mapInArrow(_befores(spark.broadcast((classes, types, top))), "word long, before int, n long").groupBy("word", "before").agg(F.sum("n").alias("n"))
    for r in _place(seen, "long", step, sizes, None).where(F.col("c") >= PLACED).select("word", "class").collect():
        classes[r["word"]] = r["class"]
    moves = materialize(learned.mapInArrow(_transitions(spark.broadcast((classes, top))), "word binary, before int, n long").groupBy("word", "before").agg(F.sum("n").alias("n")), "moves")
    tail = materialize(_place(moves.where("word is not null"), "binary", step, sizes, classes[top:]), "tail")
    joint = np.zeros((k, k))
    for r in moves.where("word is null").collect():
        joint.flat[r.before] += r.n
    for r in tail.select("class", F.explode("befores").alias("b")).groupBy("b.before", "class").agg(F.sum("b.n").alias("n")).collect():
        joint[r.before, r["class"]] += r.n
    release(moves)
    words = np.bincount(classes[1:top], minlength=k).astype(float)
    for r in tail.groupBy("class").agg(F.count("*").alias("words")).collect():
        words[r["class"]] += r.words
    # one unseen word in each class but that of the end
    step, spread = _steps(joint), np.log10(joint.sum(0) + words + 1)

    logs = np.log10(1 + np.array([ends, *map(head.__getitem__, ranked[1:]), *[0] * OTHER], float))
    shared = spark.broadcast((logs, classes, step, spread, top))
    doc = "struct<doc_id: long, held_out: boolean, n_tokens: long, known: long, logs: double, rest: double>"
    rows = texts.mapInArrow(_scores(shared), f"rid long, word binary, before int, own int, n long, doc {doc}")
    joined = rows.join(tail.select("word", "c", "class"), "word", "left")
    to = F.coalesce("class", "own")
    rest = F.get(_constants(step), F.col("before") * k + to) - F.get(_constants(spread), to)
    sums = joined.groupBy("rid").agg(
        F.max("doc").alias("doc"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("logs"), F.sum(F.col("n") * rest).alias("rest"),
    )
    logs = F.col("doc.logs") + F.col("logs")
    return sums.select(
        "doc.doc_id", "doc.held_out", "doc.n_tokens", (F.col("doc.known") + F.col("known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (logs - F.col("doc.n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"), (logs + F.col("doc.rest") + F.col("rest")).alias("score"),
    )
