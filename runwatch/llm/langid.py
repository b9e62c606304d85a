"""Language by unigram pieces, summed over all segmentations of every word.

The pieces are fixed: the letter pieces of a public vocabulary and the 256 single bytes, which
any text can fall back to.  A language is a probability for each piece.  The probability of a
word in a language is the sum over all ways to cut it into pieces, found by a forward
recursion; a text is the product of its words.  Piece probabilities are fitted by
expectation-maximisation with the same recursion, forwards and backwards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, words
from .hmm import Lookup

VOCABULARY = "piece_bpe_32k.model"
#: piece probabilities are fitted on about so many texts of each language
SAMPLE = 400
ROUNDS = 4
#: longest piece in bytes; a piece is one 64-bit number
LONGEST = 8
#: longer words are cut into parts of so many bytes
PART = 32
UNKNOWN = "und"
#: columns added on the way into Python
LOWER, LETTERS = "__lower", "__letters"
_LETTER_BYTES = (((np.arange(256) | 32) >= 97) & ((np.arange(256) | 32) <= 122)) | (np.arange(256) >= 128)


def pieces(name: str = VOCABULARY) -> np.ndarray:
    """The letter pieces of the vocabulary in lower case, and all bytes, as numbers."""
    import public_tokenizers as public
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public.path(name))
    texts = {model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size())}
    found = {int.from_bytes(t.encode(), "big") for t in texts
             if t and t.isalpha() and len(t.encode()) <= LONGEST}
    return np.array(sorted(found | set(range(256))), np.uint64)


class Segmenter:
    """All segmentations of words over fixed pieces."""

    def __init__(self, codes: np.ndarray):
        mixed = words.mix(codes)
        self.order = np.argsort(mixed)
        self.find = Lookup(mixed[self.order], bits=18)
        self.size = len(codes)

    def number(self, code: np.ndarray) -> np.ndarray:
        """Piece number, or ``size`` for what is no piece."""
        at = self.find(words.mix(code))
        return np.where(at >= 0, self.order[at], self.size)

    def steps(self, table: np.ndarray):
        """(begin, end, piece numbers) of all pieces in words of equal length, by rising end."""
        width = table.shape[1]
        for end in range(1, width + 1):
            code = np.zeros(len(table), np.uint64)
            for size in range(1, min(end, LONGEST) + 1):
                code = code | (table[:, end - size].astype(np.uint64) << np.uint64(8 * (size - 1)))
                yield end - size, end, self.number(code)

    def forward(self, table: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Natural log of the summed probability of each row, one column per language.

        ``share`` has a row of zeros at the end for what is no piece.
        """
        total = np.zeros((table.shape[1] + 1, len(table), share.shape[1]))
        total[0] = 1.0
        for begin, end, piece in self.steps(table):
            hit = np.flatnonzero(piece < self.size)
            if len(hit):
                total[end, hit] += total[begin, hit] * share[piece[hit]]
        return np.log(total[-1])

    def counts(self, table: np.ndarray, weight: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in the rows, for one language."""
        width = table.shape[1]
        steps = list(self.steps(table))
        ahead = np.zeros((width + 1, len(table)))
        behind = np.zeros((width + 1, len(table)))
        ahead[0] = behind[width] = 1.0
        for begin, end, piece in steps:
            ahead[end] += ahead[begin] * share[piece]
        out = np.zeros(self.size + 1)
        for begin, end, piece in reversed(steps):
            use = share[piece] * behind[end]
            behind[begin] += use
            out += np.bincount(piece, weight * ahead[begin] * use / ahead[width], self.size + 1)
        return out[:-1]


def distinct_words(data: np.ndarray, at: np.ndarray):
    """(start, stop) of the distinct words or word parts, the number of each word's, its text."""
    hashes, starts, stops, owners = [], [], [], []
    for h, start, stop, owner in words.words(data, at, _LETTER_BYTES, lower=False):
        long = stop - start > PART
        if long.any():
            repeat = np.where(long, -(-(stop - start) // PART), 1)
            index = np.repeat(np.arange(len(start)), repeat)
            step = np.arange(len(index)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            begin = start[index] + step * PART
            end = np.minimum(begin + PART, stop[index])
            # parts of long words are not shared: their hash is their place
            h = np.where(repeat[index] > 1, words.mix(begin.astype(np.uint64)), h[index])
            start, stop, owner = begin, end, owner[index]
        hashes.append(h)
        starts.append(start)
        stops.append(stop)
        owners.append(owner)
    if not hashes:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    _, first, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    return np.concatenate(starts)[first], np.concatenate(stops)[first], number, np.concatenate(owners)


def _by_length(data: np.ndarray, start: np.ndarray, stop: np.ndarray, rows: int = 1 << 14):
    """(word numbers, byte table) of words of equal length, in tables of bounded size."""
    size = stop - start
    for width in np.unique(size):
        same = np.flatnonzero(size == width)
        for lo in range(0, len(same), rows):
            some = same[lo:lo + rows]
            yield some, data[start[some][:, None] + np.arange(width)[None, :]]


def fit(texts: dict[str, list[str]], codes: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities, one column per language in the order of the keys, and a row of zeros."""
    cutter = Segmenter(codes)
    out = np.zeros((len(codes) + 1, len(texts)))
    for k, sample in enumerate(texts.values()):
        tables: dict[int, Counter] = {}
        for text in sample:
            data, at = words.texts_of(pa.array([text]))
            start, stop, number, _ = distinct_words(data, at)
            times = np.bincount(number, minlength=len(start))
            for a, b, n in zip(start, stop, times):
                tables.setdefault(int(b - a), Counter())[data[a:b].tobytes()] += int(n)
        share = np.append(np.full(len(codes), 1.0 / len(codes)), 0.0)
        for _ in range(rounds):
            counts = np.zeros(len(codes))
            for width, table in tables.items():
                raw = np.frombuffer(b"".join(table), np.uint8).reshape(-1, width)
                weight = np.array(list(table.values()), float)
                for lo in range(0, len(raw), 1 << 14):
                    counts += cutter.counts(raw[lo:lo + (1 << 14)], weight[lo:lo + (1 << 14)], share)
            counts += 0.05
            share = np.append(counts / counts.sum(), 0.0)
        out[:, k] = share
    return out


def learn(docs: DataFrame, folds: int, held_out: int, sample: int, vocabulary: str):
    """(piece codes, piece probabilities, languages, log shares) from texts outside the fold."""
    known = docs.where("lang IS NOT NULL").where(shared.fold(F.col("doc_id"), folds) != held_out).where(
        F.col("text").rlike("\\p{L}")).select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.lower("text").alias("text"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    names, codes = sorted(sizes), pieces(vocabulary)
    if not names:
        return codes, np.zeros((len(codes) + 1, 0)), [], np.zeros(0)
    cuts = docs.sparkSession.createDataFrame(
        [(n, int(np.ceil(1e6 * min(1.0, sample / sizes[n])))) for n in names], "lang string, _cut int")
    picked = known.join(F.broadcast(cuts), "lang").where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("_cut"))
    texts: dict[str, list[str]] = {n: [] for n in names}
    for row in picked.select("lang", "text").toLocalIterator():  # about `sample` texts a language
        texts[row["lang"]].append(row["text"])
    first = np.log(np.array([sizes[n] for n in names], float) / sum(sizes.values()))
    return codes, fit(texts, codes), names, first


def judge(batch: pa.RecordBatch, model, cutter: Segmenter):
    """Language and posterior probability of the lower-case texts of a batch."""
    _, share, names, first = model
    data, at = words.texts_of(batch.column(LOWER))
    letters = batch.column(LETTERS).to_numpy(zero_copy_only=False)
    found, scores = [], [np.zeros(0)]
    for lo, hi in words.groups_of_bytes(at, 8 * words.BLOCK):
        part, base, n = data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], hi - lo
        best, score = np.zeros(n, np.int64), np.zeros(n)
        if names:
            start, stop, number, owner = distinct_words(part, base)
            value = np.zeros((len(start), len(names)))
            for some, table in _by_length(part, start, stop):
                value[some] = cutter.forward(table, share)
            log = np.stack([np.bincount(owner, value[number, k], n) for k in range(len(names))], 1) + first
            best = log.argmax(1)
            score = 1 / np.exp(log - log.max(1, keepdims=True)).sum(1)
        good = letters[lo:hi] & bool(names)
        found += [names[b] if g else UNKNOWN for b, g in zip(best, good)]
        scores.append(np.where(good, score, 0.0))
    return found, np.concatenate(scores)


def _features() -> list[Column]:
    """What a text is judged by: its lower-case form and whether it has a letter."""
    return [F.lower("text").alias(LOWER), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias(LETTERS)]


def language(docs: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE,
             vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs (doc_id, text, lang)``.

    Languages and piece probabilities come from texts with a language outside the held-out
    fold.  ``und`` with score 0 where the text is NULL or has no letter, or where no language
    could be learned; else the most probable language and its posterior probability.  Repeated
    rows are scored each for itself, further columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(learn(docs, folds, held_out, sample, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Segmenter(shipped.value[0])
        for batch in batches:
            found, scores = judge(batch, shipped.value, cutter)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.string()), pa.array(scores)],
                ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), (shared.fold(F.col("doc_id"), folds) == held_out).alias("held_out"),
                       *_features())
    return shared.bounded(rows).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, least: float = 0.5, folds: int = 4, held_out: int = 2,
               sample: int = SAMPLE, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of ``docs``, all columns, with a language of at least that posterior probability.

    Texts that are NULL or have no letter go, and all do where no language could be learned;
    repeated rows are judged each for itself, NULL ids and columns of any name stay as they are.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(learn(docs, folds, held_out, sample, vocabulary))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Segmenter(shipped.value[0])
        for batch in batches:
            _, scores = judge(batch, shipped.value, cutter)
            kept = batch.column("_row").filter(pa.array(scores >= least))
            yield pa.RecordBatch.from_arrays(kept.flatten(), names)

    rows = docs.select(F.struct("*").alias("_row"), *_features())
    return shared.bounded(rows).mapInArrow(run, docs.schema)
