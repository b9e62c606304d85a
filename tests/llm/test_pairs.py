"""Near copies of texts and vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runwatch.llm import minhash, multiindex, shared

from test_texts import plain_words


def union(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def plain_sets(rows):
    out = {}
    for i, text in rows:
        w = plain_words(text)
        out[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    return out


def corpus():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(3000)]
    rows, base = [], rng.choice(words, 120).tolist()
    for k in range(260):  # a hot group: near copies of one text with few or many edits
        text = list(base)
        for at in rng.choice(120, k % 9, replace=False):
            text[at] = rng.choice(words)
        rows.append((1000 - k, " ".join(text)))
    rows += [(2000 + k, " ".join(base)) for k in range(40)]  # exact copies
    rows += [(3000 + k, " ".join(rng.choice(words, 60))) for k in range(60)]
    rows += [(4000, None), (4001, " \n"), (4002, "Short Text"), (4003, "short\ttext"), (4004, "short text more"),
             (4005, ""), (4006, "a b c d e"), (4007, "A b  c d E")]
    return rows


@pytest.mark.parametrize("block", [40, 128])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_shingles int, rep string")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    sets = plain_sets(rows)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a]
             and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = union(sets, links)
    assert len(got) == len(rows)
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i)
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in sets if want[i] == i}


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id is None, r.component_id or 0, r.kept) for r in out) == [
        (False, 1, True), (False, 1, True), (False, 2, True), (True, 0, True), (True, 0, True)]


def test_circulant_coordinates_estimate_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    s = minhash.signatures([np.unique(a), np.unique(b)], 512)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.06


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components_equal_union_find(spark, shape):
    rng = np.random.default_rng(2)
    if shape == "chain":
        links = [(int(a), int(b)) for a, b in zip(rng.permutation(300)[:-1], rng.permutation(300)[1:])]
        order = rng.permutation(300)
        links = [(int(a), int(b)) for a, b in zip(order, order[1:])]
    elif shape == "star":
        links = [(500, k) for k in range(1, 400)] + [(7, 7), (7, 500)]
    else:
        links = [tuple(map(int, rng.integers(0, 600, 2))) for _ in range(350)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component_id for r in shared.components(frame).collect()}
    ids = {i for a, b in links for i in (a, b) if a != b}
    want = union(ids, [(a, b) for a, b in links if a != b])
    assert got == want


def vectors():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (1, 2, None):
        for c in range(40):
            x = rng.normal(size=16)
            for k in range(120 if c == 0 else 1 + c % 4):
                away = rng.normal(size=16) * (0.0 if k % 7 == 0 else rng.uniform(0.0, 0.45))
                rows.append((n, [float(v) for v in x + away], label))
                n += 1
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [1.0, None] * 8, 1),
             (n + 4, [float("inf")] * 16, 1), (n + 5, [1.0] * 8, 1), (n + 6, [2.0] * 8, 1), (n + 7, [3.0], 2), (n + 8, [4.0], 2)]
    return rows


def brute(rows, threshold):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows
            if lab is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links = []
    for k, (i, x, lab) in enumerate(good):
        for j, y, other in good[:k]:
            if lab == other and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links.append((i, j))
    return links


@pytest.mark.parametrize("block", [16, 256])
def test_near_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(multiindex, "BLOCK", block)
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit(1))
    got = {r.vec_id: r for r in multiindex.near_vectors(frame, per_cell=20).collect()}
    links = brute(rows, 0.93)
    n_links = {i: 0 for i, _, _ in rows}
    for a, b in links:
        n_links[a] += 1
        n_links[b] += 1
    assert len(got) == len(rows)
    total = sum(n_links.values())
    assert all(got[i].n_links <= n for i, n in n_links.items())
    assert sum(r.n_links for r in got.values()) >= 0.99 * total > 1000
    want = union(n_links, links)
    assert sum(got[i].component_id == want[i] for i in want) >= 0.98 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_near_vectors_that_vary_in_few_directions(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(5000, 4)) @ rng.normal(size=(4, 64)) / 2 + 0.05 * rng.normal(size=(5000, 64))
    label = np.arange(5000) % 3
    frame = spark.createDataFrame([(k, [float(v) for v in x[k]], int(label[k])) for k in range(5000)],
                                  "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in multiindex.near_vectors(frame, per_cell=64).collect()}
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = ((x @ x.T >= 0.93) & (label[:, None] == label[None, :])).sum(1) - 1
    assert all(got[k] <= want[k] for k in range(5000))
    assert sum(got.values()) >= 0.999 * want.sum() > 50_000


def test_near_vectors_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert multiindex.near_vectors(spark.createDataFrame([], schema)).count() == 0
    x = [1.0, 0.5, 0.0, 0.25]
    rows = [(5, x, 1), (5, x, 1), (3, x, 1), (None, x, 1), (4, x, 2)]
    out = multiindex.near_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in out) == [
        (-1, 0, -1, True), (3, 1, 3, True), (4, 0, 4, True), (5, 1, 3, False), (5, 1, 3, False)]
