"""Repetition coverage against plain Python over the same texts."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from runwatch.llm import repetition, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WIDTHS = sorted(repetition.LIMITS)


def plain(text):
    text = text or ""
    w = WORD.findall(text)

    def inside(width, first):
        seen, found = {}, set()
        for i in range(len(w) - width + 1):
            gram = tuple(w[i:i + width])
            if gram in seen:
                found |= set(range(i, i + width)) | (set(range(seen[gram], seen[gram] + width)) if first else set())
            else:
                seen[gram] = i
        return found

    earlier, n_lines, again, chars = set(), 0, 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            n_lines += 1
            if line in earlier:
                again, chars = again + 1, chars + sum(map(len, WORD.findall(line)))
            earlier.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_lines": n_lines, "n_dup_lines": again, "n_repeat_words": len(inside(3, True)), "dup_line_chars": chars,
            "covered": [sum(len(w[i]) for i in inside(k, False)) for k in WIDTHS]}


def samples():
    rnd = random.Random(5)
    texts = [None, "", " \n\t\n", "a", "a\na\na", "é é é\né é é\r\né é é", "# $ | <b> #\n" * 40, "x" * 3000 + " y"]
    for _ in range(120):
        texts.append(" ".join(rnd.choice("abc") for _ in range(rnd.randrange(60))))
        texts.append("\n".join(rnd.choice(["x y z", "é", " ", "", "q # r", "x  y z"]) for _ in range(rnd.randrange(40))))
        block = " ".join(str(rnd.randrange(10**6)) for _ in range(rnd.randrange(4, 30)))
        texts.append("\n".join([block, " ".join(str(rnd.randrange(10**6)) for _ in range(60)), block]))
    return texts


@pytest.mark.parametrize("size, weak", [(1 << 20, False), (64, False), (1 << 20, True)])
def test_counts_equal_plain_counts(monkeypatch, size, weak):
    if weak:  # every hash of a window is the same: only the word-by-word comparison tells them apart
        monkeypatch.setattr(words, "mix", lambda x: np.zeros_like(x))
        monkeypatch.setattr(words, "words", _plain_words)
    texts = samples()
    data, at = words.texts_of(pa.array(texts))
    parts = [repetition.measure(data[at[a]:at[b]], at[a:b + 1] - at[a], WIDTHS) for a, b in words.groups_of_bytes(at, size)]
    whole = {k: np.concatenate([p[k] for p in parts]).tolist() for k in parts[0]}
    for i, text in enumerate(texts):
        assert {k: v[i] for k, v in whole.items()} == plain(text), text


def _plain_words(data, at, inside=words.NOT_SPACE, lower=True):
    """Words with numbers instead of hashes; lines all share one number."""
    number: dict = {}
    for t in range(len(at) - 1):
        begin, flag = int(at[t]), inside[data[at[t]:at[t + 1]]].astype(np.int8)
        turn = np.flatnonzero(np.diff(np.concatenate([[0], flag, [0]]))) + begin
        for a, b in zip(turn[::2], turn[1::2]):
            h = number.setdefault(data[a:b].tobytes(), len(number)) if inside is words.NOT_SPACE else 0
            yield np.array([h], np.uint64), np.array([a]), np.array([b]), np.array([t])


def test_rules(spark):
    fresh = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    texts = {1: fresh(1), 2: fresh(2, 49), 3: "a b c " * 30, 4: "\n".join([fresh(4, 40), *["same line here again"] * 6]),
             5: fresh(5) + "\n" + fresh(5, 12), 6: fresh(6) + " " + fresh(6, 4), 7: None, 8: ""}
    docs = spark.createDataFrame([(i, t, 1, False) for i, t in texts.items()] + [(None, texts[1], 1, True), (1, texts[1], 1, True)],
                                 "doc_id long, text string, n_words int, kept boolean")
    rows = repetition.quality_rules(docs).collect()
    got = {r["doc_id"]: (r["base_failed"], r["kept"], r["reasons"]) for r in rows}
    assert len(rows) == 10
    assert got[1] == got[None] == (False, True, []) and got[6] == (False, True, [])
    assert got[2] == (True, False, ["few_words"]) and got[7] == got[8] == got[2]
    assert got[3][:2] == (True, False) and "repeated_words" in got[3][2]
    assert got[4][:2] == (False, False) and got[4][2][:2] == ["repeated_lines", "repeated_line_chars"]
    assert got[5][:2] == (False, False) and got[5][2][-1] == "repeated_10_grams"
    assert repetition.quality_rules(docs.limit(0)).count() == 0


def test_a_whole_long_text_counts(spark):
    text = " ".join(f"n{i}" for i in range(400_000)) + " " + " ".join(f"n{i}" for i in range(50_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = repetition.quality_rules(docs).first()
    assert (r["n_words"], r["n_repeat_words"]) == (450_000, 100_000)
    assert r["covered"] == [sum(len(f"n{i}") for i in range(50_000))] * 6 and r["kept"]
