"""Toxicity by multiple-instance learning.

A text is a bag of sentences.  A sentence has the probability sigmoid(bias + its words' weights)
of being offensive, and a text is toxic unless none of its sentences is: a noisy-or.  Only the
labels of whole texts train the weights; the sentence scores then say where the offence is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words
from .hmm import Lookup

#: the weights are fitted on about so many labelled texts, picked by a hash of their id
SAMPLE = 12_000
#: features kept after screening, at most
FEATURES = 20_000
#: a feature must occur in so many toxic texts of the sample, and so many times as often as in others
MIN_TEXTS, MIN_RATIO = 4, 3.0
#: a weight must explain more than so many texts to be kept (an L1 penalty)
TEXTS_OF_PENALTY = 0.36
#: a word counts as itself and by its beginnings of so many bytes
HEADS = (4, 5, 6)
LIMIT = 0.3
_BREAKS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


def bag(data: np.ndarray, at: np.ndarray):
    """(features by word, sentence number, text number) of all words, and sentence numbers of bytes.

    Sentence numbers run through the batch; a new text begins a new sentence.
    """
    step = _BREAKS[data].astype(np.int64)
    number = np.cumsum(step) - step
    found, sentences, owners = [np.zeros((1 + len(HEADS), 0), np.uint64)], [np.zeros(0, np.int64)], [
        np.zeros(0, np.int64)]
    for h, start, _, owner in words.words(data, at, words.LETTERS, heads=HEADS):
        found.append(h)
        sentences.append(number[start] + owner)
        owners.append(owner)
    return np.concatenate(found, axis=1), np.concatenate(sentences), np.concatenate(owners), number


def _groups(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        data, at = words.texts_of(batch.column("text"))
        for lo, hi in words.groups_of_bytes(at, 2 * words.BLOCK):
            part, base = data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
            yield batch, lo, hi - lo, base, bag(part, base)


def _hits(find: Lookup, features: np.ndarray, sentence: np.ndarray, owner: np.ndarray):
    """Distinct (sentence number, feature) and the sentences that occur at all, with their text."""
    seen, first = np.unique(sentence, return_index=True)
    cells = []
    for row in features:
        slot = find(row)
        hit = np.flatnonzero(slot >= 0)
        cells.append(np.searchsorted(seen, sentence[hit]) * (len(find.keys) + 1) + slot[hit])
    cell = np.unique(np.concatenate(cells))
    return cell // (len(find.keys) + 1), cell % (len(find.keys) + 1), seen, owner[first]


def screen(picked: DataFrame) -> np.ndarray:
    """Sorted hashes of the features that toxic texts of the sample have more often than others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, n, _, (features, _, owner, _) in _groups(batches):
            toxic = batch.column("toxic").slice(lo, n).to_numpy() > 0
            for row in features:
                keep = row != 0
                pair = np.unique(np.stack([row[keep], owner[keep].astype(np.uint64)]), axis=1)
                key, index = np.unique(pair[0], return_inverse=True)
                positive = np.bincount(index, toxic[pair[1].astype(np.int64)], len(key))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(positive.astype(np.int64)),
                     pa.array(np.bincount(index, minlength=len(key)).astype(np.int64))], ["f", "bad", "n"])

    totals = picked.agg(F.count("*"), F.sum("toxic")).first()
    bad, rest = int(totals[1] or 0), int(totals[0]) - int(totals[1] or 0)
    counts = shared.bounded(picked.select("toxic", "text")).mapInArrow(run, "f long, bad long, n long")
    counts = counts.groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    lift = (F.col("bad") / max(bad, 1)) / ((F.col("n") - F.col("bad") + 0.5) / max(rest, 1))
    chosen = counts.where((F.col("bad") >= MIN_TEXTS) & (lift >= MIN_RATIO))
    top = chosen.orderBy(F.col("bad").desc(), lift.desc(), "f").limit(FEATURES).select("f").toPandas()
    return np.sort(top["f"].to_numpy(np.int64).view(np.uint64))


def _bags(picked: DataFrame, key: np.ndarray) -> pd.DataFrame:
    """(toxic, sentences, sentence, feature): what is left of a sampled text after screening."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(key)
        for batch, lo, n, _, (features, sentence, owner, _) in _groups(batches):
            place, slot, seen, text = _hits(find, features, sentence, owner)
            border = np.searchsorted(text, np.arange(n + 1))
            cut = np.searchsorted(text[place], np.arange(n + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").slice(lo, n), pa.array(np.maximum(np.diff(border), 1)),
                 pa.array([(place[cut[i]:cut[i + 1]] - border[i]).astype(np.int64).tobytes() for i in range(n)],
                          pa.binary()),
                 pa.array([slot[cut[i]:cut[i + 1]].astype(np.int64).tobytes() for i in range(n)], pa.binary())],
                ["toxic", "sentences", "sentence", "feature"])

    return picked.select("toxic", "text").mapInArrow(
        run, "toxic int, sentences long, sentence binary, feature binary").toPandas()


def fit(rows: pd.DataFrame, width: int, rounds: int = 200, texts: float = TEXTS_OF_PENALTY):
    """(weights, bias) by proximal Adam on the noisy-or likelihood."""
    y = rows["toxic"].to_numpy(float)
    n = len(y)
    if n == 0 or y.min() == y.max():
        base = np.clip(y.mean() if n else 0.0, 0.001, 0.999)
        return np.zeros(width), float(np.log(base / (1 - base)))
    first = np.concatenate([[0], np.cumsum(rows["sentences"].to_numpy(np.int64))])
    local = [np.frombuffer(v, np.int64) for v in rows["sentence"]]
    sentence = np.concatenate([s + first[i] for i, s in enumerate(local)])
    word = np.concatenate([np.frombuffer(v, np.int64) for v in rows["feature"]])
    bags = np.repeat(np.arange(n), np.diff(first))
    w, bias = np.zeros(width), -5.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(sentence, w[word], len(bags))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(bags, np.log1p(-np.minimum(p, 1 - 1e-12)), n))
        pull = np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0)[bags] * p / n
        g = np.append(np.bincount(word, pull[sentence], width), pull.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = 0.1 / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-6)
        step = rate * m / (1 - 0.9 ** t)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - rate[:-1] * texts / n, 0.0)
        bias -= step[-1]
    return w, float(bias)


def judge(batch: pa.RecordBatch, model, find: Lookup, offending: float = 0.5):
    """Scores of the texts of a batch, and for each the byte spans of its offending sentences."""
    _, weight, bias = model
    empty = np.log1p(-1 / (1 + np.exp(-bias)))
    scores, spans = [np.zeros(0)], []
    for _, _, n, base, (features, sentence, owner, number) in _groups(iter([batch])):
        place, slot, seen, text = _hits(find, features, sentence, owner)
        z = bias + np.bincount(place, weight[slot], len(seen))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clear = np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), n) + np.where(
            np.bincount(text, minlength=n) == 0, empty, 0.0)
        found = [[] for _ in range(n)]
        for k in np.flatnonzero(p >= offending):
            i = int(text[k])
            inside = number[base[i]:base[i + 1]] + i
            a, b = np.searchsorted(inside, [seen[k], seen[k] + 1])
            found[i].append({"start": int(a), "stop": int(b), "score": float(p[k])})
        scores.append(-np.expm1(clear))
        spans += found
    return np.concatenate(scores), spans


def learn(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, sample: int = SAMPLE):
    """(feature hashes, weights, bias) from labels outside the held-out fold."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(
        shared.fold(F.col("doc_id"), folds) != held_out).select(
        F.col("doc_id").cast("long"), F.col("toxic").cast("int")).distinct()
    cut = int(np.ceil(1e6 * min(1.0, sample / max(known.count(), 1))))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(cut))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    # about `sample` narrow rows at any size of the input, so they may be broadcast
    picked = shared.stored(texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text"))
    key = screen(picked)
    weight, bias = fit(_bags(picked, key), len(key))
    live = np.flatnonzero(weight)
    return key[live], weight[live], bias


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2,
             sample: int = SAMPLE, limit: float = LIMIT) -> DataFrame:
    """``doc_id, held_out, score, predicted, offending`` for every row of ``docs (doc_id, text)``.

    ``offending`` holds byte spans and scores of offending sentences.  Labels outside the
    held-out fold train the weights; a NULL label is none.  NULL and empty texts are one empty
    sentence.  Repeated rows are scored each for itself.  Without labels of both kinds every
    text gets the base rate.  Further columns are not read.
    """
    model = learn(docs, labels, folds, held_out, sample)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(shipped.value[0])
        for batch in batches:
            scores, spans = judge(batch, shipped.value, find)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array(spans, span)],
                ["doc_id", "held_out", "score", "offending"])

    rows = docs.select(F.col("doc_id").cast("long"),
                       (shared.fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "text")
    scored = shared.bounded(rows).mapInArrow(run, "doc_id long, held_out boolean, score double, "
                             "offending array<struct<start: long, stop: long, score: double>>")
    return scored.withColumn("predicted", (F.col("score") >= limit).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2,
          sample: int = SAMPLE, limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``limit``; texts are not shuffled."""
    shipped = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, folds, held_out, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Lookup(shipped.value[0])
        for batch in batches:
            scores, _ = judge(batch, shipped.value, find)
            yield batch.filter(pa.array(scores < limit))

    return shared.bounded(docs).mapInArrow(run, docs.schema)
