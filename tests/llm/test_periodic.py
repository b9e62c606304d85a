"""Runs of repeated words against every period of every text tried in turn."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from runwatch.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s = w[i:j + q]
            if j > i and len(s) >= max(6, 4 * q) and not any(s[r:] == s[:-r] for r in range(1, q)):
                out.append((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out)


def sample(rnd):
    letters, n, out = rnd.choice([1, 2, 2, 3, 5, 50]), rnd.choice([0, 1, 5, 6, 7, 20, 40, 90]), []
    while len(out) < n:
        if rnd.random() < 0.4:
            part = [rnd.randrange(letters) for _ in range(rnd.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17]))]
            out += (part * rnd.randrange(1, 9))[:rnd.randrange(1, 60)]
        else:
            out += [rnd.randrange(letters) for _ in range(rnd.randrange(1, 9))]
    return out


@pytest.mark.parametrize("block, slice_", [(1 << 19, 1 << 20), (4, 16), (1, 2)])
def test_runs_equal_brute_force(monkeypatch, block, slice_):
    monkeypatch.setattr(periodic, "LONGEST_BLOCK", block)
    monkeypatch.setattr(periodic, "SLICE", slice_)
    rnd = random.Random(block)
    for _ in range(60):
        texts = [sample(rnd) for _ in range(rnd.randrange(1, 40))]
        ids, at = np.array([i for t in texts for i in t], np.int64), np.cumsum([0] + [len(t) for t in texts])
        got = periodic.runs_of(ids, at) if len(ids) else np.zeros((0, 4))
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t)]


@pytest.mark.parametrize("n", [2, 4, 64, 128, 1024, 8192])
def test_the_transform_is_exact(n):
    rng = np.random.default_rng(n)
    a, b = (periodic._reduced(rng.integers(0, periodic.PRIME, n).astype(float)) for _ in range(2))
    turn = periodic._Transform(n)
    x, y = turn.ahead(a[None].copy()), turn.ahead(b[None].copy())
    assert (periodic._reduced(turn.back(x.copy())[0] - a) == 0).all()
    both = turn.back(periodic._reduced(x[:, turn.mirrored] * y))[0]
    for t in {0, 1, n // 2, n - 1}:
        exact = sum(int(p) * int(q) for p, q in zip(a, np.roll(b, -t)))
        assert (int(both[t]) - exact) % periodic.PRIME == 0


def test_a_chance_zero_is_no_run():
    """Numbers that differ by the prime look equal to the transform only."""
    ids = np.array([0, periodic.PRIME] * 40 + [5] * 8)
    assert periodic.runs_of(ids, np.array([0, 88])).tolist() == [[0, 0, 80, 2], [0, 80, 8, 1]]
    lone = np.arange(64) * periodic.PRIME
    assert len(periodic.runs_of(lone, np.array([0, 64]))) == 0


def plain_report(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_the_report_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = [(None, "a b a b a b a b"), (1, None), (2, ""), (3, " \t\n"), (4, "é" * 50), (5, "x\r\n" * 9 + " y  z ")]
    for i in range(10, 400):
        vocabulary = rnd.choice([["a"], ["a", "bé"], [f"w{k}" for k in range(300)]])
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(vocabulary[k % len(vocabulary)] for k in sample(rnd) * rnd.choice([1, 3]))))
    rows += [rows[20], rows[20], (500, "tick tock " * 60_000)]
    docs = spark.createDataFrame([(i, t, "x", 4) for i, t in rows], "doc_id long, text string, runs string, g int").repartition(4)
    got = sorted((tuple(r) for r in periodic.run_report(periodic.with_planted_runs(docs)).collect()), key=str)
    want = [plain_report(i, t) for i, t in rows if i != 500]
    assert [r for r in got if r[0] != 500] == sorted(want, key=str)
    long = next(r for r in got if r[0] == 500)
    assert long[1] == 1 and long[2:6] == (0, 120_000, 2, 60_000_000)
    assert periodic.run_report(periodic.with_planted_runs(docs.limit(0))).count() == 0
