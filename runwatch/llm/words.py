"""Whole texts as arrays: word and shingle hashes straight from Arrow buffers.

A word is a run of bytes of one class (by default everything but ASCII white space).  Texts
are taken in blocks of bounded size, so temporaries stay small; a text longer than a block is
cut after a word break, or grows the block if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
NOT_SPACE = ~_SPACE
_CODES = np.arange(256)
#: letters, digits and every byte of a non-ASCII character
LETTERS = (((_CODES | 32) >= 97) & ((_CODES | 32) <= 122)) | (_CODES >= 128)
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, BLOCK + 65536)
        with np.errstate(over="ignore"):
            for name, base in (("p", _BASE), ("q", _BASE_INVERSE)):
                out = np.full(size, base, dtype=np.uint64)
                out[0] = 1
                np.multiply.accumulate(out, out=out)
                _POWERS[name] = out
    return _POWERS["p"], _POWERS["q"]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; NULL is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if column.type == pa.string() or column.type == pa.binary():
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def pieces(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(begin, end, cuts): byte ranges that together cover everything and never split a word.

    ``cuts`` are the text borders inside the range.
    """
    begin, total = 0, len(data)
    while begin < total:
        end = min(total, begin + BLOCK)
        if end < total:
            border = at[np.searchsorted(at, end, "right") - 1]
            if border > begin:
                end = int(border)
            else:
                stop = int(at[np.searchsorted(at, begin, "right")])
                while end < stop:
                    outside = np.flatnonzero(~inside[data[begin:end]])
                    if len(outside):
                        end = begin + int(outside[-1]) + 1
                        break
                    end = min(stop, end + BLOCK)
        lo, hi = np.searchsorted(at, begin, "left"), np.searchsorted(at, end, "left")
        yield begin, end, np.unique(at[lo:hi])
        begin = end


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray = NOT_SPACE, lower: bool = True,
          heads: tuple[int, ...] = ()):
    """Yield (hash, start, stop, text number) of all words, block by block, in order.

    With ``heads`` the hashes are a matrix: the word, and its first so many bytes (0 where the
    word is not longer).
    """
    for begin, end, cuts in pieces(data, at, inside):
        raw = data[begin:end]
        if lower:
            raw = LOWER[raw]
        flag = inside[raw]
        before = np.empty_like(flag)
        before[0], before[1:] = False, flag[:-1]
        first = flag & ~before
        last = np.empty_like(flag)
        last[-1], last[:-1] = flag[-1], flag[:-1] & ~flag[1:]
        inner = cuts[(cuts > begin) & (cuts < end)] - begin
        if len(inner):
            first[inner] = flag[inner]
            last[inner - 1] = flag[inner - 1]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _powers(len(raw) + 1)
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_VALUES[raw] * power[: len(raw)], out=total[1:])
        h = mix((total[stop] - total[start]) * inverse[start] ^ (stop - start).astype(np.uint64))
        if heads:
            rows = [h]
            for k in heads:
                longer = stop - start > k
                part = mix((total[np.minimum(start + k, stop)] - total[start]) * inverse[start] ^ np.uint64(1 << 20 | k))
                rows.append(np.where(longer, part, np.uint64(0)))
            h = np.stack(rows)
        start, stop = start + begin, stop + begin
        yield h, start, stop, np.searchsorted(at, start, "right") - 1


def all_words(data: np.ndarray, at: np.ndarray, inside: np.ndarray = NOT_SPACE, lower: bool = True):
    """``words`` over a whole batch: hashes and, per text, its n + 1 positions in them."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for h, _, _, owner in words(data, at, inside, lower):
        hashes.append(h)
        owners.append(owner)
    owner = np.concatenate(owners)
    return np.concatenate(hashes), np.searchsorted(owner, np.arange(len(at)), "left")


def groups_of_bytes(at: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def shingles(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words of one text.

    A shorter text gives one hash of its whole sequence, a text without words none.
    """
    n = len(h)
    if n == 0:
        return np.zeros(0, np.uint64)
    run = min(n, width)
    out = np.full(n - run + 1, run, np.uint64)
    for k in range(run):
        out += h[k:n - run + 1 + k]
        out *= np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return np.unique(mix(out))
