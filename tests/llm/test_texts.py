"""Hashes of words and shingles, token counts and packing against plain Python."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runwatch.llm import packing, tokens, words

TEXTS = [
    None, "", " ", "a", "a b  C\td\ne f g", "x" * 3000, "ä ö ü\u0085 é", "<|endoftext|> hi <|endoftext|>",
    "it's we'll 12 345 !!! \n\n  end ", "日本語 テキスト です", "emoji 😀 and Ελληνικά", "same same same same same same",
    "word " * 4000, "a\x1cb\x1d c\x0b\x0cd", "tail space   ", "ǅ ʰ ə",
]


def plain_words(text):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return (text or "").encode().translate(table).split()


@pytest.mark.parametrize("block", [8, 64, 1 << 20])
def test_words_equal_plain_words_whatever_the_block(monkeypatch, block):
    monkeypatch.setattr(words, "BLOCK", block)
    data, at = words.texts_of(pa.array(TEXTS))
    h, pos = words.all_words(data, at)
    names = {}
    for i, text in enumerate(TEXTS):
        want = plain_words(text)
        got = h[pos[i]:pos[i + 1]]
        assert len(got) == len(want)
        for w, v in zip(want, got):
            assert names.setdefault(w, v) == v
    assert len(set(names.values())) == len(names)


def test_sliced_and_large_columns_read_alike():
    whole = pa.array(TEXTS)
    for column in (whole.slice(4, 5), whole.slice(4, 5).cast(pa.large_string())):
        data, at = words.texts_of(column)
        assert [data[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == TEXTS[4:9]


def test_shingles_count_distinct_runs_of_five():
    for text in TEXTS:
        want = plain_words(text)
        data, at = words.texts_of(pa.array([text], pa.string()))
        h, _ = words.all_words(data, at)
        runs = {tuple(want[i:i + 5]) for i in range(len(want) - 4)} or ({tuple(want)} if want else set())
        assert len(words.shingles(h)) == len(runs)


def library(text):
    exact, _ = tokens._encoders(tokens.VOCABULARY)
    return exact.encode(text or "", add_special_tokens=False).ids


def frame(spark, texts, **more):
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, length int")


def test_counts_equal_the_library(spark):
    rows = {r.doc_id: r for r in tokens.count_tokens(frame(spark, TEXTS), limit=100).collect()}
    for i, text in enumerate(TEXTS):
        n = len(library(text))
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((text or "").encode()), n > 100)
    assert tokens.count_tokens(frame(spark, [])).count() == 0


def test_long_and_repeated_texts_are_counted_in_balanced_batches(spark, monkeypatch):
    long = "some words, 12 and 34 more. " * 12_000
    texts = [long, long + "日本", "x" * 300_000, None, "a b", "a b", ""]
    rows = spark.createDataFrame(
        [(None if i == 4 else min(i, 5), t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = tokens.count_tokens(rows.coalesce(1)).toPandas()
    assert got["n_tokens"].tolist() == [len(library(t)) for t in texts]
    assert got["n_bytes"].tolist() == [len((t or "").encode()) for t in texts]
    assert got["doc_id"].isna().tolist() == [i == 4 for i in range(7)]
    monkeypatch.setattr(tokens, "BATCH_BYTES", 50)
    monkeypatch.setattr(tokens, "GROUP_BYTES", 300)
    column = pa.array(TEXTS * 3)
    assert tokens.lengths(column).tolist() == [len(library(t)) for t in TEXTS] * 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 90), max_size=60))
def test_balanced_ranges_follow_each_other(sizes):
    ranges = tokens.balanced(np.array(sizes, np.int64), 100)
    inside = [i for a, b in ranges for i in range(a, b)]
    assert inside == list(range(len(sizes))) if sum(sizes) else ranges == []
    assert all(sum(sizes[a:b]) <= 100 + 90 for a, b in ranges)


def test_both_encoders_agree_below_the_border():
    low = [chr(c) for c in range(1, 0x280)]
    texts = ["".join(low)] + [f"a{c}b {c} {c}{c}1" for c in low]
    for got, text in zip(tokens.encode(texts, True), texts):
        assert got.tolist() == library(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 \n\t.'é<|", max_size=400))
def test_parts_change_no_token(text):
    cut = tokens.parts(text, 7)
    assert "".join(cut) == text
    assert [i for p in cut for i in library(p)] == library(text)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 9)))
def test_plan_places_every_item_once_and_fills_bins_gapless(histogram):
    rows = packing.plan_bins(histogram, 60)
    bins: dict[int, list] = {}
    ranks = Counter()
    for n, first, end, base, each, offset in rows:
        assert first == ranks[n] and end > first
        ranks[n] = end
        for r in range(first, end):
            k = r - first
            bins.setdefault(base + k // each, []).append((offset + k % each * n, n))
    assert ranks == Counter({n: c for n, c in histogram.items() if c})
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 60
    total = sum(n * c for n, c in histogram.items())
    assert len(bins) <= max(1, 2 * total / 60 + 1)


def test_packing_keeps_every_token_of_every_document(spark):
    texts = TEXTS + ["hot copy of a text"] * 60
    docs = frame(spark, texts)
    rows = packing.pack(docs, capacity=32).toPandas()
    ids = {i: library(t) + [0] for i, t in enumerate(texts)}
    assert rows.groupby("doc_id")["length"].sum().to_dict() == {i: len(v) for i, v in ids.items()}
    for r in rows.itertuples():
        cut = ids[r.doc_id][r.start:r.start + r.length]
        assert zlib.crc32(np.array(cut, "<u4").tobytes()) == r.ids_crc32
        assert r.piece == 0 or r.length == 32
    for _, group in rows.sort_values("offset").groupby("sequence_id"):
        assert group["length"].sum() <= 32
        assert group["offset"].tolist() == [0, *group["length"].cumsum()[:-1]]
    whole = packing.encode_pieces(docs, 32).toPandas()
    assert all(len(v) == 4 * n for v, n in zip(whole["ids"], whole["length"]))
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_takes_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c")], "doc_id long, text string")
    out = packing.pack(rows).collect()
    assert len(out) == 4 and len({(r.sequence_id, r.offset) for r in out}) == 4


def test_batches_are_bounded_in_bytes(spark):
    from runwatch.llm import shared

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("64m", str(shared.BATCH_BYTES)), ("1m", "1m")):
            spark.conf.set(key, given)
            shared.bounded(spark.range(1))
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)
