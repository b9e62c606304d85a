"""A hidden Markov language model over all words of a corpus.

The chain emits word classes: frequent words are a class each, other words fall into a class by
shape (their first and last bytes).  Inside a shape class a word has its smoothed share of the
class, and unseen words together the share that words seen once had.  Every class, state and
word count comes from all training documents: counts are aggregated by Spark, and each
Baum-Welch round sums the expected counts of all partitions.

Words are known by 64-bit hashes.  Counts of the most frequent ones travel as a table of fixed
size; the other words of a text are joined with the whole vocabulary, so no count is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

STATES = 8
#: words with a class of their own, shape classes, words whose counts are broadcast
OWN, SHAPES, FREQUENT = 4096, 2048, 200_000
#: the first rounds find a start from one training document in so many, whole and picked by a hash
START_ONE_IN, START_ROUNDS = 4, 12
#: Baum-Welch rounds over all training documents
ROUNDS = 3
#: training sequences are at most this long; a longer document is several sequences
SEGMENT = 512
#: documents of more tokens are scored through products of transfer matrices
LONG = 8192
ADD = 0.1


def word_shapes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Shape class of each word from its first byte and its last two, in lower case."""
    first = words.LOWER[data[start]].astype(np.uint64)
    last = words.LOWER[data[stop - 1]].astype(np.uint64)
    second = words.LOWER[data[np.maximum(stop - 2, start)]].astype(np.uint64)
    long = np.minimum(stop - start, 3).astype(np.uint64)
    code = (((first << np.uint64(8) | second) << np.uint64(8) | last) << np.uint64(2)) | long
    return (words.mix(code) >> np.uint64(20)).astype(np.int64) % SHAPES


class Lookup:
    """Position of 64-bit keys in a sorted table, or -1; one gather per key and slot."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys, self.shift = keys, np.uint64(64 - bits)
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.start = np.searchsorted(keys, edges).astype(np.int64)
        ends = np.append(self.start[1:], len(keys))
        self.steps = int((ends - self.start).max()) if len(keys) else 0
        self.padded = np.append(keys, np.zeros(self.steps + 1, np.uint64))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        at = self.start[(h >> self.shift).astype(np.int64)]
        for k in range(self.steps):
            hit = self.padded[at + k] == h
            out[hit] = at[hit] + k
        out[out >= len(self.keys)] = -1
        return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """``h, shape, c``: hash, shape class and count of every word of ``docs (text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = words.texts_of(batch.column("text"))
            for lo, hi in words.groups_of_bytes(at, 16 * words.BLOCK):
                part, base = data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
                hashes, shapes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for h, start, stop, _ in words.words(part, base):
                    hashes.append(h)
                    shapes.append(word_shapes(part, start, stop))
                key, first, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(np.concatenate(shapes)[first].astype(np.int32)),
                     pa.array(n.astype(np.int64))], ["h", "shape", "c"])

    counted = shared.bounded(docs.select("text")).mapInArrow(run, "h long, shape int, c long")
    return counted.groupBy("h").agg(F.min("shape").alias("shape"), F.sum("c").alias("c"))


class Model:
    """Tables of fixed size: class of a word, shares inside a class, chain parameters."""

    def __init__(self, n_docs, n_words, distinct, frequent, shapes):
        """``frequent``: (h, shape, c) arrays by falling count; ``shapes``: shape -> (sum, once)."""
        self.total = int(n_docs + n_words)
        self.distinct = int(distinct + (n_docs > 0))
        h, shape, c = frequent
        self.classes = 1 + OWN + SHAPES
        cls = 1 + OWN + shape
        cls[:OWN] = 1 + np.arange(len(h[:OWN]))
        order = np.argsort(h)
        self.keys, self.counts, self.cls = h[order], c[order].astype(np.float64), cls[order].astype(np.int64)
        self.end = float(n_docs)
        mass = np.zeros(SHAPES)
        once = np.zeros(SHAPES)
        for s, (total, singles) in shapes.items():
            mass[s], once[s] = total, singles
        own_c, own_shape = c[:OWN], shape[:OWN]
        np.add.at(mass, own_shape, -(own_c + ADD))
        np.add.at(once, own_shape, -(own_c == 1).astype(float))
        self.unseen = np.maximum(once, 0) + ADD
        self.log_class = np.zeros(self.classes)
        inside = np.maximum(mass, 0) + self.unseen
        self.log_class[1 + OWN:] = np.log10(inside)
        share = np.full(self.classes, ADD)
        share[0] += n_docs
        share[1:1 + len(own_c)] += own_c
        share[1 + OWN:] = inside
        self.share = share / share.sum()
        self.log_all = float(np.log10(self.total + ADD * (self.distinct + 1)))


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """Texts as class sequences, with the words outside the frequent table left to a join."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        find, log_count = Lookup(m.keys), np.log10(m.counts + ADD)
        for batch in batches:
            data, at = words.texts_of(batch.column("text"))
            for lo, hi in words.groups_of_bytes(at, 4 * words.BLOCK):
                part, base = data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
                hashes, shapes, owners = [], [], []
                for h, start, stop, owner in words.words(part, base):
                    hashes.append(h)
                    shapes.append(word_shapes(part, start, stop))
                    owners.append(owner)
                h = np.concatenate([np.zeros(0, np.uint64), *hashes])
                shape = np.concatenate([np.zeros(0, np.int64), *shapes])
                owner = np.concatenate([np.zeros(0, np.int64), *owners])
                n = hi - lo
                length = np.bincount(owner, minlength=n)
                slot = find(h)
                seen = slot >= 0
                cls = 1 + OWN + shape
                cls[seen] = m.cls[slot[seen]]
                value = np.zeros(len(h))
                value[seen] = log_count[slot[seen]]
                base_sum = np.bincount(owner, value, n) + np.log10(m.end + ADD)
                inner = np.bincount(owner, np.where(cls > OWN, value, 0.0), n).astype(float)
                # every text is followed by the end token, class 0
                whole = np.zeros(len(h) + n, np.uint16)
                cut = np.concatenate([[0], np.cumsum(length + 1)])
                whole[np.arange(len(h)) + owner] = cls
                text = whole.astype("<u2")
                rest = np.flatnonzero(~seen)
                edge = np.searchsorted(owner[rest], np.arange(n + 1)).astype(np.int32)
                pick = lambda a: pa.ListArray.from_arrays(pa.array(edge), pa.array(a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, n), batch.column("fold").slice(lo, n),
                     pa.array((length + 1).astype(np.int64)),
                     pa.array((np.bincount(owner[seen], minlength=n) + (m.end > 0)).astype(np.int64)),
                     pa.array(base_sum), pa.array(inner),
                     pa.array([text[cut[i]:cut[i + 1]].tobytes() for i in range(n)], pa.binary()),
                     pick(h[rest].view(np.int64)), pick(shape[rest].astype(np.int16))],
                    ["doc_id", "fold", "n_tokens", "known", "base", "inner", "classes", "rare", "rare_shape"])

    return shared.bounded(docs).mapInArrow(
        run, "doc_id long, fold int, n_tokens long, known long, base double, inner double, "
        "classes binary, rare array<long>, rare_shape array<short>")


def start_parameters(model: Model, states: int, seed: int = 11):
    rng = np.random.default_rng(seed)
    emit = model.share[None, :] * rng.gamma(2.0, 0.5, (states, model.classes))
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return np.full(states, 1.0 / states), move, emit / emit.sum(1, keepdims=True)


def expected(sequences: list[np.ndarray], params) -> np.ndarray:
    """Expected starts, moves and emissions of class sequences, flattened to one vector."""
    first, move, emit = (p.astype(np.float32) for p in params)
    states, classes = emit.shape
    starts, moves, emissions = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
    parts = [s[k:k + SEGMENT] for s in sequences for k in range(0, len(s), SEGMENT)]
    parts.sort(key=len, reverse=True)
    by_class = np.ascontiguousarray(emit.T)
    lo = 0
    while lo < len(parts):
        steps = len(parts[lo])
        block = parts[lo:lo + max(64, (1 << 19) // steps)]
        lo += len(block)
        n = len(block)
        length = np.array([len(p) for p in block])
        seen = np.zeros((steps, n), np.int64)
        for i, p in enumerate(block):
            seen[:len(p), i] = p
        active = np.array([int((length > t).sum()) for t in range(steps)])
        alpha = np.empty((steps, n, states), np.float32)
        given = by_class[seen]
        a = first * given[0]
        a /= a.sum(1, keepdims=True)
        alpha[0] = a
        for t in range(1, steps):
            k = active[t]
            a = (alpha[t - 1, :k] @ move) * given[t, :k]
            a /= a.sum(1, keepdims=True)
            alpha[t, :k] = a
        beta = np.ones((n, states), np.float32)
        back = move.T.copy()
        for t in range(steps - 1, -1, -1):
            k = active[t]
            gamma = alpha[t, :k] * beta[:k]
            gamma /= gamma.sum(1, keepdims=True)
            if t:
                ahead = given[t, :k] * beta[:k]
                scale = ((alpha[t - 1, :k] @ move) * ahead).sum(1, keepdims=True)
                ahead /= scale
                moves += (alpha[t - 1, :k].T @ ahead) * move
                beta[:k] = ahead @ back
                beta[:k] /= beta[:k].max(1, keepdims=True)
            else:
                starts += gamma.sum(0)
            given[t, :k] = gamma
        valid = np.arange(steps)[:, None] < length[None, :]
        where, weight = seen[valid], given[valid]
        for s in range(states):
            emissions[s] += np.bincount(where, weight[:, s], classes)
    return np.concatenate([starts, moves.ravel(), emissions.ravel()])


def maximise(counts: np.ndarray, model: Model, states: int):
    """Parameters from expected counts, smoothed so that nothing is impossible."""
    first = counts[:states] + 0.1
    move = counts[states:states + states * states].reshape(states, states) + 0.1
    emit = counts[states + states * states:].reshape(states, -1) + 20.0 * model.share
    return first / first.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)


def log_likelihood(sequences: list[np.ndarray], params) -> np.ndarray:
    """log10 probability of each class sequence by the scaled forward recursion; exact."""
    first, move, emit = params
    states = len(first)
    by_class = np.ascontiguousarray(emit.T)
    out = np.zeros(len(sequences))
    length = np.array([len(s) for s in sequences], np.int64)
    order = [i for i in np.argsort(-length, kind="stable") if 0 < length[i] <= LONG]
    if order:
        steps = length[order[0]]
        flat = np.concatenate([sequences[i] for i in order])
        at = np.concatenate([[0], np.cumsum(length[order])])[:-1]
        active = np.searchsorted(-length[order], -np.arange(1, steps + 1), "right")
        log = np.zeros(len(order))
        a = np.tile(first, (len(order), 1))
        for t in range(steps):
            k = active[t]
            a = (a[:k] @ move if t else a[:k]) * by_class[flat[at[:k] + t]]
            s = a.sum(1)
            a /= s[:, None]
            log[:k] += np.log10(s)
        out[order] = log
    for i in np.flatnonzero(length > LONG):
        out[i] = _long(sequences[i], first, move, by_class, states)
    return out


def _long(sequence: np.ndarray, first, move, by_class, states: int) -> float:
    """One long sequence: transfer matrices of its segments side by side, then their product."""
    a = first * by_class[sequence[0]]
    log = np.log10(a.sum())
    a /= a.sum()
    rest = sequence[1:]
    cut = len(rest) // SEGMENT * SEGMENT
    chain = rest[:cut].reshape(-1, SEGMENT)
    total = np.tile(np.eye(states), (len(chain), 1, 1))
    scale = np.zeros(len(chain))
    for t in range(SEGMENT if len(chain) else 0):
        total = (total @ move) * by_class[chain[:, t]][:, None, :]
        s = total.sum((1, 2))
        total /= s[:, None, None]
        scale += np.log10(s)
    for k in range(len(chain)):
        a = a @ total[k]
        s = a.sum()
        a, log = a / s, log + np.log10(s) + scale[k]
    for c in rest[cut:]:
        a = (a @ move) * by_class[c]
        s = a.sum()
        a, log = a / s, log + np.log10(s)
    return float(log)


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v, "<u2").astype(np.int64) for v in column.to_pylist()]


def _counted(sequences: DataFrame, params) -> np.ndarray:
    """Expected counts of all sequences, summed over the partitions; empty without any sequence."""
    shipped = sequences.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                one = expected(_sequences(batch.column("classes").slice(lo, 1024)), shipped.value)
                total = one if total is None else total + one
        if total is not None:
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array(total[full])], ["at", "value"])

    summed = sequences.mapInArrow(run, "at int, value double").groupBy("at").agg(
        F.sum("value").alias("value")).toPandas()
    first, _, emit = params
    counts = np.zeros(len(first) * (1 + len(first)) + emit.size)
    counts[summed["at"].to_numpy()] = summed["value"].to_numpy()
    return counts if len(summed) else counts[:0]


def train(encoded: DataFrame, model: Model, states: int = STATES, rounds: int = ROUNDS):
    """Baum-Welch: rounds over a fixed share of the documents find a start, then all documents take part.

    The share is picked by a hash of id and text, so it grows with the corpus and does not
    depend on the layout of the files.  A round without any document changes nothing.
    """
    params = start_parameters(model, states)
    sequences = encoded.select("classes")
    picked = F.pmod(F.xxhash64("doc_id", "classes"), F.lit(START_ONE_IN)) == 0
    sample = shared.stored(encoded.where(picked).select("classes"))
    for rows in [sample] * START_ROUNDS + [sequences] * rounds:
        counts = _counted(rows, params)
        if len(counts):
            params = maximise(counts, model, states)
    return params


def score(encoded: DataFrame, model: Model, params) -> DataFrame:
    shipped = encoded.sparkSession.sparkContext.broadcast((params, model.log_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, log_class = shipped.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                sequences = _sequences(batch.column("classes").slice(lo, 4096))
                total = log_likelihood(sequences, chain) - np.array([log_class[s].sum() for s in sequences])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("uid").slice(lo, 4096), pa.array(total)], ["uid", "chain"])

    return encoded.select("uid", "classes").mapInArrow(run, "uid long, chain double")


def _frequent(vocab: DataFrame, most: int) -> DataFrame:
    """The words above a count that at most ``most`` words reach.

    The count comes from a histogram of fixed size, so no partition sends its own top list.
    """
    level = F.floor(F.log2("c") * 16).cast("int")
    bins = vocab.groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect()
    total, least = 0, 1 << 30
    for row in bins:
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    return vocab.where(level >= least)


def language_model(docs: DataFrame, folds: int = 10, held_out: int = 0, states: int = STATES,
                   rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    NULL and empty texts are the end token alone; repeated rows count and are scored each for
    itself; a NULL id falls into the fold of the empty text.  Without any training document all
    counts are 0 and the start parameters score.  An empty table gives an empty result; further
    columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text",
                       shared.fold(F.col("doc_id"), folds).cast("int").alias("fold"))
    training = docs.where(F.col("fold") != held_out)
    vocab = shared.stored(vocabulary(training))
    n_docs = training.count()
    sums = vocab.groupBy("shape").agg(
        F.count("*").alias("n"), F.sum("c").alias("c"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("once"))
    sums = sums.toPandas()  # at most SHAPES rows
    top = _frequent(vocab, FREQUENT).toPandas().sort_values(["c", "h"], ascending=[False, True])
    model = Model(
        n_docs, int(sums["c"].sum()), int(sums["n"].sum()),
        (top["h"].to_numpy(np.int64).view(np.uint64), top["shape"].to_numpy(np.int64), top["c"].to_numpy(np.int64)),
        {int(r.shape_): (r.c + ADD * r.n, r.once) for r in sums.rename(columns={"shape": "shape_"}).itertuples()})
    encoded = shared.stored(encode(docs, model).withColumn("uid", F.monotonically_increasing_id()))
    params = train(encoded.where(F.col("fold") != held_out), model, states, rounds)
    # words outside the frequent table meet the whole vocabulary
    unseen = spark.createDataFrame(
        [(int(k), float(v)) for k, v in enumerate(np.log10(model.unseen))], "s int, log_unseen double")
    rare = encoded.select("uid", F.explode(F.arrays_zip("rare", "rare_shape")).alias("w"))
    rare = rare.select("uid", F.col("w.rare").alias("h"), F.col("w.rare_shape").cast("int").alias("s"))
    rare = rare.join(vocab.select("h", "c"), "h", "left").join(F.broadcast(unseen), "s")
    log_count = F.log10(F.coalesce("c", F.lit(0)) + ADD)
    rare = rare.groupBy("uid").agg(
        F.sum(log_count).alias("rare_base"), F.count("c").alias("rare_known"),
        F.sum(F.when(F.col("c").isNull(), F.col("log_unseen")).otherwise(log_count)).alias("rare_inner"))
    out = encoded.select("uid", "doc_id", "fold", "n_tokens", "known", "base", "inner").join(
        rare, "uid", "left").join(score(encoded, model, params), "uid")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "doc_id", (F.col("fold") == held_out).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base") - F.col("n_tokens") * model.log_all).alias("base_score"),
        (F.col("inner") + zero("rare_inner") + F.col("chain")).alias("score"))
