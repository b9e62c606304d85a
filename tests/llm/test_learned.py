"""Learned operators: exact recursions against enumeration, and held-out quality."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runwatch.llm import hmm, langid, quality, shared, toxicity

from test_texts import TEXTS, plain_words

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score double"


def small(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, 0.5) for i, t in enumerate(texts)], DOCS)


def remainder(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    up = label.sum()
    return (order[label == 1].sum() - up * (up + 1) / 2) / (up * (len(label) - up))


# -- hidden Markov model ---------------------------------------------------------------------

def chain(states=3, classes=5, seed=0):
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.dirichlet(np.ones(s[-1]), s[:-1] or None)
    return draw(states), draw(states, states), draw(states, classes)


def test_forward_equals_the_sum_over_all_paths():
    first, move, emit = chain()
    for seq in ([0], [1, 4, 2], [3, 3, 0, 1, 2]):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(seq)):
            p = first[path[0]] * emit[path[0], seq[0]]
            for t in range(1, len(seq)):
                p *= move[path[t - 1], path[t]] * emit[path[t], seq[t]]
            total += p
        got = hmm.log_likelihood([np.array(seq), np.zeros(0, np.int64)], (first, move, emit))
        assert got[0] == pytest.approx(np.log10(total)) and got[1] == 0


def test_long_sequences_take_the_product_of_matrices(monkeypatch):
    params = chain(seed=1)
    seq = np.random.default_rng(2).integers(0, 5, 777)
    want = hmm.log_likelihood([seq], params)[0]
    monkeypatch.setattr(hmm, "LONG", 10)
    monkeypatch.setattr(hmm, "SEGMENT", 50)
    assert hmm.log_likelihood([seq], params)[0] == pytest.approx(want, rel=1e-12)


def test_expected_counts_equal_the_sum_over_all_paths():
    first, move, emit = chain(seed=3)
    seqs = [np.array([0, 1, 4, 2]), np.array([3]), np.array([2, 2])]
    starts, moves, emissions = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for seq in seqs:
        paths, weight = list(itertools.product(range(3), repeat=len(seq))), []
        for path in paths:
            p = first[path[0]] * emit[path[0], seq[0]]
            for t in range(1, len(seq)):
                p *= move[path[t - 1], path[t]] * emit[path[t], seq[t]]
            weight.append(p)
        for path, p in zip(paths, np.array(weight) / sum(weight)):
            starts[path[0]] += p
            for t, s in enumerate(path):
                emissions[s, seq[t]] += p
                if t:
                    moves[path[t - 1], s] += p
    got = hmm.expected(seqs, (first, move, emit))
    assert got == pytest.approx(np.concatenate([starts, moves.ravel(), emissions.ravel()]), abs=1e-4)


@pytest.mark.parametrize("frequent", [20, 200_000])
def test_language_model_counts_equal_plain_ones(spark, monkeypatch, frequent):
    monkeypatch.setattr(hmm, "FREQUENT", frequent)
    texts = TEXTS + ["the cat sat on the mat", "A cat and THE dog", "never seen words here", "the the the"] * 6
    docs = small(spark, texts)
    got = {r.doc_id: r for r in hmm.language_model(docs, rounds=1).collect()}
    held = {i: remainder(i, 10) == 0 for i in range(len(texts))}
    count = Counter()
    for i, t in enumerate(texts):
        if not held[i]:
            count.update(plain_words(t) + ["<end>"])
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        own = plain_words(t) + ["<end>"]
        base = sum(np.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(own), n)
        assert r.n_known == sum(w in count for w in own)
        assert r.base_score == pytest.approx(base) and r.score < 0


def test_language_model_without_training_rows(spark):
    assert hmm.language_model(small(spark, [])).count() == 0
    alone = spark.createDataFrame([(k, "a b", "", 0.0) for k in range(400) if remainder(k, 10) == 0][:3], DOCS)
    rows = hmm.language_model(alone).collect()
    assert len(rows) == 3 and all(r.held_out and r.n_known == 0 and r.base_score == pytest.approx(0.0) for r in rows)
    null = spark.createDataFrame([(None, None, None, None)] * 2, DOCS)
    assert [r.n_tokens for r in hmm.language_model(null).collect()] == [1, 1]


def test_the_chain_does_not_depend_on_the_layout_of_the_documents(spark):
    docs = shared.documents(spark, SF).where("doc_id < 400")
    scores = [
        hmm.language_model(rows).toPandas().set_index("doc_id")["score"].sort_index()
        for rows in (docs.coalesce(1), docs.orderBy(F.col("doc_id").desc()).repartition(7))]
    assert np.allclose(*scores, rtol=1e-3)


def test_rounds_without_documents_keep_the_start(spark):
    none = hmm._counted(spark.createDataFrame([], "classes binary"), (np.ones(2), np.ones((2, 2)), np.ones((2, 5))))
    assert len(none) == 0


def test_held_out_texts_are_likelier_than_by_counts(spark):
    rows = hmm.language_model(shared.documents(spark, SF)).where("held_out").toPandas()
    assert rows["score"].sum() > 0.95 * rows["base_score"].sum()
    assert (rows["score"] > rows["base_score"]).mean() > 0.9


# -- language --------------------------------------------------------------------------------

def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "abb", "é", "bé"]
    codes = np.array(sorted({int.from_bytes(p.encode(), "big") for p in pieces} | set(range(256))), np.uint64)
    rng = np.random.default_rng(0)
    share = np.append(rng.dirichlet(np.ones(len(codes))), 0.0)
    cutter = langid.Segmenter(codes)
    number = {int(c): k for k, c in enumerate(codes)}

    def total(word, weight=None):
        if not word:
            return 1.0
        out = 0.0
        for n in range(1, len(word) + 1):
            k = number.get(int.from_bytes(word[:n], "big"))
            if k is not None and not (n > 1 and word[0] == 0):
                out += share[k] * total(word[n:])
        return out

    for word in ("abba", "a", "abbaabé", "xéz"):
        raw = word.encode()
        table = np.frombuffer(raw, np.uint8)[None, :]
        assert cutter.forward(table, share[:, None])[0, 0] == pytest.approx(np.log(total(raw)))
        counts = cutter.counts(table, np.ones(1), share)
        used = sum(counts[number[int(c)]] * max(1, (int(c).bit_length() + 7) // 8) for c in codes)
        assert used == pytest.approx(len(raw))  # expected pieces cover the word


def test_language_of_held_out_texts(spark):
    docs = shared.documents(spark, SF)
    rows = langid.language(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(rows) == docs.count() and rows["score"].between(0, 1).all()
    assert (rows["held_out"] == rows["doc_id"].map(lambda i: remainder(i, 4) == 2)).all()
    held = rows[rows["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98


def test_language_of_odd_texts(spark):
    texts = [None, "", " 12 !?", "the house", "x" * 5000, "日本", "a"] + ["the and of with that"] * 20
    got = {r.doc_id: r for r in langid.language(small(spark, texts)).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["und"] * 3 + ["en"] * 4
    assert got[0].score == 0.0 and 0 < got[3].score <= 1
    unknown = small(spark, texts, None)
    assert {r.lang_pred for r in langid.language(unknown).collect()} == {"und"}
    assert langid.language(small(spark, [])).count() == 0
    kept = langid.identified(small(spark, texts))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == len(texts) - 3
    odd = small(spark, texts + ["the and of with that"]).withColumns({
        c: F.concat(F.lit(c), F.col("text")) for c in ("__lower", "__letters", "_row", "held_out")})
    rows = langid.identified(odd).collect()
    assert len(rows) == len(texts) - 2
    assert all(r[c] == c + r["text"] for r in rows for c in ("__lower", "__letters", "_row", "held_out"))


# -- toxicity and quality --------------------------------------------------------------------

def test_toxicity_finds_the_texts_and_the_sentences(spark):
    rng = np.random.default_rng(0)
    plain = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(900):
        parts = [" ".join(rng.choice(plain, 8)) for _ in range(6)]
        bad = i % 5 == 0
        if bad:
            parts[i % 6] += " " + rng.choice(["nastyone", "nastytwo", "NASTYish"])
        rows.append((i, ". ".join(parts) + ".", "en", 0.0))
        labels.append((i, int(bad), None))
    docs = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs, known).toPandas().set_index("doc_id")
    truth = np.array([i % 5 == 0 for i in got.index])
    assert ((got["predicted"] == 1).to_numpy() == truth).mean() > 0.99
    for i, text, _, _ in rows:
        if i % 5 == 0:
            spans = got.loc[i, "offending"]
            assert len(spans) == 1
            assert "nasty" in text.encode()[spans[0]["start"]:spans[0]["stop"]].decode().lower()
    kept = toxicity.clean(docs, known)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(got.index[got["score"] < toxicity.LIMIT])


def test_toxicity_and_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, None, None), (None, 0, 1)], "doc_id long, toxic int, quality int")
    for texts in ([], TEXTS):
        for out in (toxicity.toxicity(small(spark, texts), labels), quality.quality(small(spark, texts), labels),
                    toxicity.toxicity(small(spark, texts), labels.limit(0)),
                    quality.quality(small(spark, texts), labels.limit(0))):
            rows = out.collect()
            assert len(rows) == len(texts)
            assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_learned_labels_on_held_out_texts(spark):
    docs, labels = shared.documents(spark, SF), shared.labels(spark, SF)
    known = labels.toPandas().set_index("doc_id")
    for out, name, folds, rest, least in ((toxicity.toxicity(docs, labels), "toxic", 4, 2, 0.8),
                                          (quality.quality(docs, labels), "quality", 5, 0, 0.97)):
        rows = out.toPandas()
        assert len(rows) == docs.count()
        assert (rows["held_out"] == rows["doc_id"].map(lambda i: remainder(i, folds) == rest)).all()
        held = rows[rows["held_out"] & rows["doc_id"].isin(known.index)]
        assert auc(held["score"].to_numpy(), known.loc[held["doc_id"], name].to_numpy()) > least


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs = shared.documents(spark, SF)
    labels = shared.labels(spark, SF)
    turned = labels.withColumns({
        "toxic": F.when(shared.fold(F.col("doc_id"), 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")),
        "quality": F.when(shared.fold(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality"))})
    for run in (toxicity.toxicity, quality.quality):
        a, b = (run(docs, one).select("doc_id", "score").toPandas().set_index("doc_id")["score"].sort_index()
                for one in (labels, turned))
        assert np.allclose(a, b, atol=1e-6)


def test_the_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    good = rng.normal(2, 1, 4000)
    mixed = np.concatenate([rng.normal(2, 1, 2800), rng.normal(-2, 1, 1200)])
    assert abs(quality.prior(good, mixed) - 0.7) < 0.06
