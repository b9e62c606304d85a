"""Repetition coverage: how much of a text lies inside n-grams and lines that it has said before.

A batch of texts is one array of word hashes.  Prefix sums of hash times power give the rolling
hash of every window of every length from one array; equal windows of a text are found by one
sort.  A window can only repeat where its shorter beginning repeats, so each length sorts what
the length before left.  Equal hashes are compared word by word before they count.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, words

#: share of word characters, in percent, that windows of so many words may repeat
LIMITS: Mapping[int, int] = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: the same for whole lines: percent of the lines, and of the word characters
LINES, LINE_CHARS = 30, 20
#: words of the windows of the base rule, least words of a text, percent of repeated words
BASE_WINDOW, LEAST_WORDS, BASE_REPEATED = 3, 50, 50

_NOT_NEWLINE = np.arange(256) != 10
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "dup_line_chars")


class Windows:
    """Rolling hashes over the words of some texts; ``text`` numbers the text of each word."""

    def __init__(self, hashes: np.ndarray, text: np.ndarray):
        self.hashes, self.text = hashes, text
        n = len(hashes)
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        self._inverse = np.full(n + 1, _INVERSE, np.uint64)
        self._inverse[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(self._inverse, out=self._inverse)
        self._total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * power[:n], out=self._total[1:])

    def starts(self, width: int, among: np.ndarray | None = None) -> np.ndarray:
        """Where a window of ``width`` words lies inside one text, of ``among`` or of all words."""
        last = len(self.text) - width
        at = np.arange(max(last + 1, 0)) if among is None else among[among <= last]
        return at[self.text[at] == self.text[at + width - 1]]

    def repeats(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(later, any): which windows equal an earlier one of their text; or any other one."""
        if not len(at):
            return np.zeros(0, bool), np.zeros(0, bool)
        rolled = (self._total[at + width] - self._total[at]) * self._inverse[at]
        key = words.mix(rolled ^ words.mix(self.text[at].astype(np.uint64) + np.uint64(width)))
        order = np.argsort(key, kind="stable")
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        pair = np.flatnonzero(~fresh)
        if not self._same(at[order[pair]], at[order[pair - 1]], width):
            cells = np.stack([self.text[at].astype(np.uint64), *[self.hashes[at + k] for k in range(width)]], axis=1)
            _, key = np.unique(cells, axis=0, return_inverse=True)
            order = np.argsort(key, kind="stable")
            fresh[1:] = key[order[1:]] != key[order[:-1]]
        later = np.empty(len(at), bool)
        later[order] = ~fresh
        shared_ = ~fresh
        shared_[:-1] |= ~fresh[1:]
        some = np.empty(len(at), bool)
        some[order] = shared_
        return later, some

    def _same(self, a: np.ndarray, b: np.ndarray, width: int) -> bool:
        equal = self.text[a] == self.text[b]
        for k in range(width):
            equal &= self.hashes[a + k] == self.hashes[b + k]
        return bool(equal.all())

    def covered(self, at: np.ndarray, width: int) -> np.ndarray:
        """Which words lie in a window that begins at one of ``at``."""
        edge = np.zeros(len(self.text) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + width, -1)
        return np.cumsum(edge[:-1]) > 0


def _gathered(data: np.ndarray, at: np.ndarray, inside: np.ndarray):
    """Hashes, starts, stops and text numbers of all runs of ``inside`` bytes."""
    found = [(h, a, b, t) for h, a, b, t in words.words(data, at, inside, lower=False)]
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    return tuple(np.concatenate(part) for part in zip(*found))


def _repeated_lines(data, hashes, start, stop, text) -> np.ndarray:
    """Lines equal to an earlier line of their text: by hash, and every hit byte by byte."""
    later, _ = Windows(hashes, text).repeats(np.arange(len(text)), 1)
    if later.any():
        seen: dict[tuple, int] = {}
        part = np.isin(hashes, hashes[later])
        for i in np.flatnonzero(part):
            line = (text[i], data[start[i]:stop[i]].tobytes())
            later[i] = line in seen
            seen[line] = i
    return later


def measure(data: np.ndarray, at: np.ndarray, widths: list[int]) -> dict[str, np.ndarray]:
    """The counts of each text between the offsets ``at``; ``covered`` has a column for each width."""
    texts = len(at) - 1
    per_text = lambda t, weight=None: np.bincount(t, weight, texts).astype(np.int64)
    hashes, start, stop, text = _gathered(data, at, words.NOT_SPACE)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[stop] - points[start]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    windows = Windows(hashes, text)
    base = windows.starts(BASE_WINDOW)
    _, some = windows.repeats(base, BASE_WINDOW)
    found = {"n_words": per_text(text), "word_chars": per_text(text, chars),
             "n_symbols": symbols[at[1:]] - symbols[at[:-1]],
             "n_repeat_words": per_text(text[windows.covered(base[some], BASE_WINDOW)])}
    left, last, covered = base[some], BASE_WINDOW, np.zeros((texts, len(widths)), np.int64)
    for k, width in enumerate(widths):
        here = windows.starts(width, left if width >= last else None)
        later, some = windows.repeats(here, width)
        inside = windows.covered(here[later], width)
        covered[:, k] = per_text(text[inside], chars[inside])
        left, last = here[some], width
    found["covered"] = covered

    line_hash, line_start, line_stop, line_text = _gathered(data, at, _NOT_NEWLINE)
    lo, hi = np.searchsorted(start, line_start, "left"), np.searchsorted(start, line_stop, "left")
    solid = hi > lo
    line_hash, line_start, line_stop, line_text = (x[solid] for x in (line_hash, line_start, line_stop, line_text))
    again = _repeated_lines(data, line_hash, line_start, line_stop, line_text)
    total = np.concatenate([[0], np.cumsum(chars)])
    line_chars = (total[hi] - total[lo])[solid]
    return found | {
        "n_lines": per_text(line_text), "n_dup_lines": per_text(line_text[again]),
        "dup_line_chars": per_text(line_text[again], line_chars[again])}


def repetition(docs: DataFrame, widths: list[int] = list(LIMITS)) -> DataFrame:
    """``doc_id``, the counts of each text and ``covered ARRAY<LONG>``, an entry for each width.

    ``covered`` and ``dup_line_chars`` count the word characters inside windows of so many words,
    or lines, that equal an earlier one of the same text; the first of equal ones is not counted.
    """
    widths = sorted(widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = words.texts_of(batch.column("text"))
            parts = [measure(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], widths)
                     for lo, hi in words.groups_of_bytes(at, words.BLOCK)]
            if not parts:
                continue
            whole = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * len(widths)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(whole[c]) for c in _COUNTS],
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(whole["covered"].ravel()))],
                ["doc_id", *_COUNTS, "covered"])

    narrow = shared.bounded(docs.select(F.col("doc_id").cast("long"), "text"))
    return narrow.mapInArrow(run, "doc_id long, " + "".join(f"{c} long, " for c in _COUNTS) + "covered array<long>")


def quality_rules(docs: DataFrame, limits: Mapping[int, int] = LIMITS, lines: int = LINES,
                  line_chars: int = LINE_CHARS) -> DataFrame:
    """``repetition`` with ``base_failed``, ``reasons`` (the rules a text breaks) and ``kept``.

    The base rule fails a text of fewer than 50 words or with more than half of its words in
    three-word windows that occur twice.  The others fail a text that repeats more than its
    percentage of word characters in windows of n words (``limits``) or in lines
    (``line_chars``), or more than ``lines`` percent of its lines.  A NULL or empty text has
    zeros everywhere and fails the base rule; a NULL id stays NULL; repeated rows give repeated
    results; other columns are not read.
    """
    widths = sorted(limits)
    counted = repetition(docs, widths)
    few = F.col("n_words") < LEAST_WORDS
    repeated = 100 * F.col("n_repeat_words") > BASE_REPEATED * F.col("n_words")
    rules = [(few, "few_words"), (repeated, "repeated_words"),
             (100 * F.col("n_dup_lines") > lines * F.col("n_lines"), "repeated_lines"),
             (100 * F.col("dup_line_chars") > line_chars * F.col("word_chars"), "repeated_line_chars")]
    rules += [(100 * F.col("covered")[k] > limits[w] * F.col("word_chars"), f"repeated_{w}_grams")
              for k, w in enumerate(widths)]
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))
    return counted.withColumns({"base_failed": few | repeated, "reasons": reasons}).withColumn(
        "kept", F.size("reasons") == 0)
