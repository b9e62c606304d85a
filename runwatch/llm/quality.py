"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are texts labelled good; web text without a look at its labels is the
unlabelled set.  The features of a text are the frequencies of neighbouring byte kinds (letters,
capitals, digits, marks, spaces, line ends) and a few ratios, so any text has the same size to
the model.  The class prior is estimated from the two samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

#: the model is fitted on about so many positives and so many unlabelled texts
POSITIVES, UNLABELLED = 6_000, 12_000
LIMIT = 0.3
#: byte kinds; every other ASCII byte is a kind of its own with the control bytes
_KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r",
          ".", ",;:", "!?", "#", "$", "%", "&", "*", "|", "'\"()-/_"]
KINDS = len(_KINDS) + 2
_KIND = np.full(256, KINDS - 1)
_KIND[128:] = KINDS - 2
for _k, _chars in enumerate(_KINDS):
    _KIND[[ord(c) for c in _chars]] = _k
WIDTH = KINDS * KINDS + 6


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``WIDTH`` numbers per text; an empty text has zeros and its length."""
    n = len(at) - 1
    size = np.diff(at)
    out = np.zeros((n, WIDTH), np.float32)
    kind = _KIND[data].astype(np.int64)
    owner = np.repeat(np.arange(n), size)
    if len(kind) > 1:
        inside = owner[1:] == owner[:-1]
        code = (owner[1:] * KINDS + kind[:-1]) * KINDS + kind[1:]
        pair = np.bincount(code[inside], minlength=n * KINDS * KINDS).reshape(n, -1)
        out[:, :KINDS * KINDS] = np.sqrt(pair / np.maximum(size - 1, 1)[:, None])
    h, pos = words.all_words(data, at)
    count = np.diff(pos)
    owner = np.repeat(np.arange(n), count)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    distinct = np.bincount(owner[new], minlength=n)
    some = np.maximum(count, 1)
    lines = np.bincount(np.repeat(np.arange(n), size), kind == 4, n)
    out[:, -6] = np.log1p(count)
    out[:, -5] = distinct / some
    out[:, -4] = np.log1p(size / some)
    out[:, -3] = lines / some
    out[:, -2] = np.log(np.maximum(distinct, 1)) / np.log(np.maximum(count, 2))
    out[:, -1] = count == 0
    return out


def _blocks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        data, at = words.texts_of(batch.column("text"))
        for lo, hi in words.groups_of_bytes(at, 2 * words.BLOCK):
            for a in range(lo, hi, 2048):
                b = min(hi, a + 2048)
                yield batch, a, b - a, features(data[at[a]:at[b]], at[a:b + 1] - at[a])


def _collected(rows: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, x in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    got = shared.bounded(rows.select("text")).mapInArrow(run, "x binary").toPandas()["x"]
    return np.frombuffer(b"".join(got), np.float32).reshape(len(got), WIDTH).astype(np.float64)


class Scorer:
    """Standardised features and their squares into one linear score."""

    def __init__(self, x: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.w = np.zeros(2 * x.shape[1] + 1)

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z * z - 1, np.ones((len(z), 1))], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.design(x) @ self.w)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(w, gradient, rounds: int, rate: float, decay: float):
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = gradient(w) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def prior(good: np.ndarray, mixed: np.ndarray) -> float:
    """Share of positives in ``mixed``: the least ratio of the two tails of a score.

    mixed >= share * good holds in every tail, with equality where no negative is left.
    """
    good, mixed = np.sort(good), np.sort(mixed)
    cut = np.quantile(good, np.linspace(0.05, 0.6, 23))
    tail = lambda s: 1 - np.searchsorted(s, cut, "left") / len(s)
    return float(np.clip((tail(mixed) / np.maximum(tail(good), 1e-9)).min(), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 300) -> Scorer | float:
    """Minimise the non-negative unbiased risk of the logistic loss."""
    if len(positive) < 5 or len(unlabelled) < 5:
        return 0.5
    scorer = Scorer(np.concatenate([positive, unlabelled]))
    p, u = scorer.design(positive), scorer.design(unlabelled)
    # a first classifier of positives against the mixture orders the texts for the prior
    half = np.arange(len(p)) % 2 == 0, np.arange(len(u)) % 2 == 0

    def against(w):
        return (-(1 - _sigmoid(p[half[0]] @ w)) @ p[half[0]] / half[0].sum()
                + _sigmoid(u[half[1]] @ w) @ u[half[1]] / half[1].sum())

    start = _descend(scorer.w, against, 150, 0.03, 2e-3)
    share = prior(p[~half[0]] @ start, u[~half[1]] @ start)

    def risk(w):
        gp, gu = _sigmoid(p @ w), _sigmoid(u @ w)
        negative = np.log1p(np.exp(np.clip(u @ w, -30, 30))).mean() - share * np.log1p(
            np.exp(np.clip(p @ w, -30, 30))).mean()
        minus = gu @ u / len(u) - share * (gp @ p) / len(p)
        if negative < 0:  # over-fitted: climb back until the part is not negative
            return -minus
        return share * (-(1 - gp) @ p) / len(p) + minus

    scorer.w = _descend(np.zeros_like(start), risk, rounds, 0.03, 1e-3)
    return scorer


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0,
            positives: int = POSITIVES, unlabelled: int = UNLABELLED, limit: float = LIMIT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs (doc_id, text)``.

    Positives are labels outside the held-out fold; the unlabelled sample comes from documents
    outside it.  NULL and empty texts have features of their own.  With fewer than five texts of
    either sample every score is 0.5.  Repeated rows are scored each for itself, further columns
    are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text",
                       (shared.fold(F.col("doc_id"), folds) == held_out).alias("held_out"))
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").where(
        shared.fold(F.col("doc_id"), folds) != held_out).select(F.col("doc_id").cast("long")).distinct()

    def share(rows: DataFrame, wanted: int, seed: int) -> DataFrame:
        cut = int(np.ceil(1e6 * min(1.0, wanted / max(rows.count(), 1))))
        return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < F.lit(cut))

    picked = docs.join(F.broadcast(share(good, positives, 1)), "doc_id")  # about `positives` ids
    model = fit(_collected(picked), _collected(share(docs.where(~F.col("held_out")), unlabelled, 2)))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shipped.value
        for batch, at, n, x in _blocks(batches):
            value = scorer(x) if isinstance(scorer, Scorer) else np.full(n, float(scorer))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, n), batch.column("held_out").slice(at, n),
                 pa.array(value.astype(np.float64))], ["doc_id", "held_out", "score"])

    scored = shared.bounded(docs).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= limit).cast("int"))
