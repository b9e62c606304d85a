"""Runs of repeated words, found by block convolution.

At scale B the texts are cut into blocks of B words.  A run with a period d from B to 2B - 1 and
at least four periods holds two whole neighbouring blocks that occur again d words later.  The
sum of squared differences between a block and every window of the next 2B words is a
correlation, computed with a number-theoretic transform over the integers modulo a prime: it is
0 wherever the block occurs again.  Neighbouring blocks with the same distance seed a run, whose
borders are found by comparing words.  Scales double from 1 to a quarter of the longest text.

The transform is split into factors of at most 64, each a matrix product whose sums stay below
2^53, so that doubles hold the integers exactly.  A sum that is 0 only modulo the prime costs a
comparison, never a wrong run.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

#: prime 7 * 2^20 + 1 with generator 3: transforms of up to 2^20 numbers
PRIME, GENERATOR = 7_340_033, 3
#: largest factor of a transform done as one matrix product
FACTOR = 64
#: longest block of one transform; longer scales take several windows
LONGEST_BLOCK = 1 << 19
#: numbers transformed at a time
SLICE = 1 << 20
#: a run has at least this many periods, and at least so many words
PERIODS, LEAST = 4, 6
#: bytes of texts worked on at a time; a longer text is a group of its own
GROUP_BYTES = 1 << 20


def _reduced(x: np.ndarray) -> np.ndarray:
    """Whole doubles below 2^53 modulo the prime, to -PRIME/2 .. PRIME/2, in place."""
    x -= np.rint(x * (1.0 / PRIME)) * PRIME
    return x


def _root_powers(n: int, exponents: np.ndarray, scale: int = 1) -> np.ndarray:
    """``scale * w^e`` for the n-th root of unity w, as centred doubles."""
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    table = np.array([scale * pow(root, e, PRIME) % PRIME for e in range(n)], float)
    return _reduced(table[exponents % n])


@functools.lru_cache(maxsize=None)
class _Transform:
    """Forward and backward transform of rows of ``n`` numbers; frequencies in an order of its own."""

    def __init__(self, n: int):
        self.n = n
        self.first = n if n <= FACTOR else min(FACTOR, 1 << (n.bit_length() // 2))
        self.rest = n // self.first
        k = np.arange(self.first)
        grid = np.outer(k, k)
        self._ahead = _root_powers(self.first, grid)
        self._back = _root_powers(self.first, -grid, pow(self.first, -1, PRIME))
        if self.rest == 1:
            self.order = k
        else:
            self.inner = _Transform(self.rest)
            twist = np.outer(k, np.arange(self.rest))
            self._twist, self._untwist = _root_powers(n, twist), _root_powers(n, -twist)
            self.order = (k[:, None] + self.first * self.inner.order[None, :]).ravel()
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        #: where the frequency -f of each frequency f is
        self.mirrored = place[-self.order % n]
        #: what moving a row by n / 2 places does to each frequency
        self.half_turn = 1.0 - 2.0 * (self.order % 2)

    def ahead(self, x: np.ndarray) -> np.ndarray:
        if self.rest == 1:
            return _reduced(x @ self._ahead)
        y = _reduced(np.matmul(self._ahead, x.reshape(-1, self.first, self.rest)))
        y *= self._twist
        return self.inner.ahead(_reduced(y).reshape(-1, self.rest)).reshape(-1, self.n)

    def back(self, x: np.ndarray) -> np.ndarray:
        if self.rest == 1:
            return _reduced(x @ self._back)
        y = self.inner.back(x.reshape(-1, self.rest)).reshape(-1, self.first, self.rest)
        y *= self._untwist
        return _reduced(np.matmul(self._back, _reduced(y))).reshape(-1, self.n)


def _recurring(values: np.ndarray, scale: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(block length, least distance, hits): hits[k, t] says that block k occurs again at distance
    least + t, up to chance modulo the prime; all distances from ``scale`` to 2 scale - 1.

    ``values`` are centred modulo the prime.  Blocks are transformed a slice at a time, so only
    the hits, a byte a word, grow with a long text.
    """
    b = min(scale, LONGEST_BLOCK)
    m = -(-len(values) // b)
    padded = np.zeros((m + 2 * scale // b) * b)
    padded[:len(values)] = values
    squares = np.concatenate([[0.0], np.cumsum(_reduced(padded * padded))])
    turn, step = _Transform(2 * b), max(1, SLICE // (2 * b))
    for j in range(scale // b, 2 * scale // b):
        hits = np.empty((m, b), bool)
        for k in range(0, m, step):
            stop = min(k + step, m)
            hits[k:stop] = _zeros(padded, squares, turn, k, stop, j)
        yield b, j * b, hits


def _zeros(padded, squares, turn, begin, stop, j) -> np.ndarray:
    """Where the squared differences of the blocks ``begin`` to ``stop`` and the windows from j to
    j + 1 blocks later add up to 0 modulo the prime."""
    b, m = turn.n // 2, stop - begin
    rows = np.zeros((m + j + 1, 2 * b))
    rows[:, :b] = padded[begin * b:(stop + j + 1) * b].reshape(-1, b)
    spectrum = turn.ahead(rows)
    window = spectrum[j + 1:j + 1 + m] * turn.half_turn
    window += spectrum[j:j + m]
    window *= spectrum[:m, turn.mirrored]
    both = turn.back(_reduced(window))[:, :b]
    at = np.arange(begin * b, stop * b).reshape(m, b)
    own = squares[at[:, :1] + b] - squares[at[:, :1]]
    later = squares[at + (j + 1) * b] - squares[at + j * b]
    return _reduced(own + later - 2.0 * both) == 0


class _Found:
    """Runs of smaller scales: tells whether a stretch of words lies inside one of them."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        runs = sorted(runs)
        self._start = np.array([r[0] for r in runs])
        self._stop = np.maximum.accumulate(np.array([r[1] for r in runs])) if runs else self._start

    def hold(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        if not len(self._start):
            return np.zeros(len(start), bool)
        k = np.searchsorted(self._start, start, "right") - 1
        return (k >= 0) & (self._stop[np.maximum(k, 0)] >= stop)


def _chains(hits: np.ndarray, b: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, distance) of maximal rows of blocks with the same distance, if they are long enough."""
    both = hits[:-1] & hits[1:]
    if not both.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros((1, b), bool)
    lag, first = np.nonzero((both & ~np.concatenate([edge, both[:-1]])).T)
    _, last = np.nonzero((both & ~np.concatenate([both[1:], edge])).T)
    start, stop, d = first * b, (last + 2) * b, least + lag
    # a run repeats (PERIODS - 1) d words; at its ends less than a block each is not whole
    enough = stop - start >= np.maximum((PERIODS - 1) * d, LEAST - d) - 2 * (b - 1)
    return start[enough], stop[enough], d[enough]


def runs_of(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """All runs of several texts: rows (text, start, length, period), sorted.

    ``ids`` are word numbers of all texts, text i from ``at[i]`` to ``at[i + 1]``; start counts
    from the beginning of its text.
    """
    sizes = np.diff(at)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= LEAST]
    if not len(order):
        return np.zeros((0, 4), np.int64)
    # longest text first, a number of its own between texts: each scale reads a prefix
    begin = np.concatenate([[0], np.cumsum(sizes[order] + 1)])
    top = int(ids.max()) + 1
    line = np.empty(int(begin[-1]), np.int64)
    line[begin[1:] - 1] = top + np.arange(len(order))
    body = np.ones(len(line), bool)
    body[begin[1:] - 1] = False
    spread = np.repeat(at[order] - begin[:-1], sizes[order] + 1)[body]
    line[body] = ids[np.flatnonzero(body) + spread]
    values = _reduced(line.astype(float))

    runs: list[tuple[int, int, int]] = []
    scale = 1
    while True:
        active = int((sizes[order] >= max(LEAST, PERIODS * scale)).sum())
        if not active:
            break
        total = int(begin[active])
        inside, more = _Found(runs), []
        for b, least, hits in _recurring(values[:total], scale):
            start, stop, distance = _chains(hits, b, least)
            new = ~inside.hold(start, stop + distance)
            for a, z, d in zip(start[new].tolist(), stop[new].tolist(), distance[new].tolist()):
                more += _extended(line[:total], a, z, d, b, inside)
        runs += more
        scale *= 2
    if not runs:
        return np.zeros((0, 4), np.int64)
    start, stop, period = np.array(runs, np.int64).T
    k = np.searchsorted(begin, start, "right") - 1
    table = np.stack([order[k], start - begin[k], stop - start, period], axis=1)
    return table[np.lexsort(table.T[::-1])]


def _extended(line, start, stop, d, b, inside) -> list[tuple[int, int, int]]:
    """The runs of period d that touch the blocks from ``start`` to ``stop``, as (start, stop, period).

    The blocks before and after are known to differ, so borders lie at most a block away.
    """
    lo, hi = max(0, start - b), min(stop + b, len(line) - d)
    same = np.zeros(hi - lo + 2, np.int8)
    same[1:-1] = line[lo:hi] == line[lo + d:hi + d]
    turn = np.flatnonzero(np.diff(same)) + lo
    found = []
    for a, z in zip(turn[::2].tolist(), turn[1::2].tolist()):
        if a < stop and z > start and z - a >= max((PERIODS - 1) * d, LEAST - d):
            if not inside.hold(np.array([a]), np.array([z + d]))[0]:
                found.append((a, z + d, d))
    return found


def _group(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Runs of the texts between the offsets ``at``, and what is left of each text without repeats."""
    texts = len(at) - 1
    found = list(words.words(data, at, lower=False))
    if not found:
        return np.zeros((0, 4), np.int64), [b""] * texts
    hashes, start, stop, text = (np.concatenate(part) for part in zip(*found))
    ids = np.unique(hashes, return_inverse=True)[1]
    first = np.searchsorted(text, np.arange(texts + 1), "left")
    runs = runs_of(ids, first)
    edge = np.zeros(len(ids) + 1, np.int64)
    begin = first[runs[:, 0]] + runs[:, 1]
    np.add.at(edge, begin + runs[:, 3], 1)
    np.add.at(edge, begin + runs[:, 2], -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    # every kept word with a space behind it, copied by position
    start, width, text = start[kept], stop[kept] - start[kept] + 1, text[kept]
    ends = np.cumsum(width)
    source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + width, width)
    source[ends - 1] = start
    joined = data[source]
    joined[ends - 1] = 32
    border = np.concatenate([[0], ends])[np.searchsorted(text, np.arange(texts + 1), "left")]
    whole = joined.tobytes()
    return runs, [whole[a:max(a, z - 1)] for a, z in zip(border[:-1].tolist(), border[1:].tolist())]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, runs ARRAY<STRUCT<start, length, period>>, collapsed`` of whole texts.

    A run is a stretch of words of smallest period q (words q apart are equal) and at least
    max(6, 4 q) words that no neighbouring word extends; runs are sorted by start, then period.
    ``collapsed`` joins by one space the words that no run holds after its first period.  A NULL
    or empty text has no words, no runs and an empty ``collapsed``; a NULL id stays NULL;
    repeated rows give repeated results; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = words.texts_of(batch.column("text"))
            tables, left = [], []
            for lo, hi in words.groups_of_bytes(at, GROUP_BYTES):
                runs, texts = _group(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                runs[:, 0] += lo
                tables.append(runs)
                left += texts
            runs = np.concatenate(tables) if tables else np.zeros((0, 4), np.int64)
            ends = np.searchsorted(runs[:, 0], np.arange(batch.num_rows + 1), "left").astype(np.int32)
            cells = pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(runs[:, k])) for k in (1, 2, 3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), cells),
                 pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    narrow = shared.bounded(docs.select(F.col("doc_id").cast("long"), "text"))
    return narrow.mapInArrow(
        run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` in which every tenth text, by the hash of its id, becomes periodic from a word on.

    With h = crc32(decimal id) and g = floor(h / 10): if h % 10 = 0 and the text has n > 0 words,
    each word i >= a becomes word a + (i - a) % p, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    A text under a NULL id stays.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    listed = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, split).alias("w"))
    n = F.size("w")
    a = F.pmod("g", F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("w", a + 1, p), times))
    edited = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), a), tail), F.lit(1), n), " ")
    return listed.select("doc_id", F.when(n > 0, edited).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """A row per document: how many runs, the longest one, and digests of all runs and of what is left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("slow"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    found = periodic_runs(docs).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.slow")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.slow")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
