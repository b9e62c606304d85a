"""Mixing and fingerprints: DataFrame operators against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from runwatch.llm import fingerprints, mixing, shared

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(spark, rows):
    return spark.createDataFrame(
        [(i, t, s, "x", 3) for i, t, s in rows],
        "doc_id long, text string, source string, target string, _size int")


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i % 17), f"s{i % 7}" if i % 3 else "hot") for i in range(900)]
    rows += [(900, None, "s1"), (901, "", None), (902, "only one", None), (903, "...", "empty ")]
    docs = corpus(spark, rows)
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    sums: dict = {}
    for i, _, s in rows:
        sums[s] = sums.get(s, 0) + size[i]
    want = plain_targets(sums)
    taken: dict = {}
    for i, _, s in rows:
        assert (got[i].size, got[i].source_size) == (size[i], sums[s])
        assert got[i].target == pytest.approx(want[s])
        assert got[i].taken % max(size[i], 1) == 0 and got[i].taken <= 3 * size[i]
        taken[s] = taken.get(s, 0) + got[i].taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 17
    again = {r.doc_id: r for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == got


def test_complete_epochs_come_before_a_fraction(spark):
    docs = corpus(spark, [(i, "a b c", "a") for i in range(10)] + [(100 + i, "d e f", "b") for i in range(90)])
    got = mixing.mix(docs).toPandas()
    a = got[got["doc_id"] < 100]
    assert a["target"].iloc[0] == 90 and (a["taken"] == 9).all()
    b = got[got["doc_id"] >= 100]
    assert b["target"].iloc[0] == 210 and b["taken"].sum() == 210


def test_mixture_repeats_whole_rows_as_often_as_they_are_taken(spark):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 4}") for i in range(200)]
    docs = corpus(spark, rows)
    taken = {r.doc_id: r.taken // max(r.size, 1) for r in mixing.mix(docs).collect()}
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    found = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert found == {i: n for i, n in taken.items() if n}


def test_higher_quality_is_taken_sooner(spark):
    rows = [(i, "w w w w", "a" if i < 400 else "b") for i in range(800)]
    docs = corpus(spark, rows)
    weight = F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0)
    got = mixing.mix(docs, quality=weight).toPandas()
    part = got[got["doc_id"] >= 400]
    assert part[part["doc_id"] % 2 == 0]["taken"].sum() > 1.5 * part[part["doc_id"] % 2 == 1]["taken"].sum()


def test_equal_rows_are_cut_at_the_target(spark):
    """A source of 100 equal rows: its target lies between epochs, and inside the equal rows."""
    rows = [(1, "w " * 10, "a")] * 100 + [(2, "w " * 7, "b")] * 50 + [(3, None, "b")] * 3 + [(4, "x " * 5, "c")] * 60
    docs = corpus(spark, rows).repartition(5)
    got = mixing.mix(docs).toPandas()
    want = plain_targets({"a": 1000, "b": 350, "c": 300})
    for source, ids, size in (("a", [1], 10), ("b", [2, 3], 7), ("c", [4], 5)):
        part = got[got["doc_id"].isin(ids)]
        assert abs(part["taken"].sum() - want[source]) <= size
        assert (part["taken"] <= 3 * part["size"]).all()
    again = mixing.mix(docs.repartition(3)).toPandas()
    order = sorted(got.columns)
    key = lambda t: t[order].sort_values(order).reset_index(drop=True)
    assert key(got).equals(key(again))
    out = mixing.mixture(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    for doc_id, size in ((1, 10), (2, 7), (4, 5)):
        assert out[doc_id] * size == got[got["doc_id"] == doc_id]["taken"].sum()


def test_mixture_keeps_columns_of_any_name(spark):
    rows = [(i, f"text {i} " + "w " * (i % 4), None if i % 9 == 0 else f"s{i % 3}") for i in range(60)] + [(None, "u v", "s1")]
    names = ["_size", "_name", "_epochs", "_last", "_row", "_copies", "_part", "_number", "_key", "_rank", "_null"]
    docs = corpus(spark, rows).drop("_size").select("*", *[F.concat(F.lit(f"{c}:"), F.col("text")).alias(c) for c in names])
    out = mixing.mixture(docs).collect()
    assert mixing.mixture(docs).columns == docs.columns
    assert {r["doc_id"] for r in out} <= {i for i, _, _ in rows} and len(out) > 30
    for r in out:
        assert all(r[c] == f"{c}:{r['text']}" for c in names)


def test_mix_of_nothing(spark):
    assert mixing.mix(corpus(spark, [])).count() == 0
    assert mixing.mixture(corpus(spark, [])).count() == 0
    empty = mixing.mix(corpus(spark, [(1, None, None), (1, None, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2


EDIT = [(9, "one two three four five six seven"), (7, ""), (5, None), (4, "äöü😀 x y z"), (3, "one two three four five six seven"),
        (1, "zz " * 500), (-2, "a")]


def test_edit_report_against_plain_python(spark):
    docs = spark.createDataFrame(EDIT, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.edit_report(docs).collect()}
    texts = [t or "" for _, t in EDIT]
    own = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    for k, (i, _) in enumerate(EDIT):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        n = len(text) // 3
        edited = text[:len(text) - n] + after[:n]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == own[i] and len(own[i]) == 32
        bits = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
        assert got[i].near_edited == bits(got[i].fingerprint, got[i].edited_fingerprint)
        assert got[i].near_next == bits(got[i].fingerprint, own[EDIT[(k + 1) % len(EDIT)][0]])
    assert own[9] == own[3] and own[7] == own[5] == "0" * 32


def test_edit_report_of_odd_tables(spark):
    schema = "doc_id long, text string, _h int, fingerprint string"
    assert fingerprints.edit_report(spark.createDataFrame([], schema)).count() == 0
    one = fingerprints.edit_report(spark.createDataFrame([(1, "abc def", 1, "")], schema)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    rows = [(None, "n", 1, ""), (2, "same", 1, ""), (2, "same", 1, ""), (2, "other", 1, "")]
    out = fingerprints.edit_report(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 4 and [r for r in out if r.doc_id is None]


def test_votes_equal_a_plain_count(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat the cat")], "doc_id long, text string")
    hashes = [r.t for r in docs.select(F.explode(fingerprints.terms(F.col("text"))).alias("t")).collect()]
    assert len(hashes) == len(set(hashes)) == 5 + 7  # words, and pairs with the open last one
    spread = docs.select(F.explode(fingerprints.terms(F.col("text"))).alias("t")).select(
        "t", *[F.xxhash64(F.lit(k), "t").alias(f"h{k}") for k in (0, 1)]).collect()
    want = ""
    for k in (0, 1):
        total = sum(1 + (r.t & 1) for r in spread)
        word = 0
        for j in range(64):
            if 2 * sum(1 + (r.t & 1) for r in spread if (r[f"h{k}"] >> j) & 1) > total:
                word |= 1 << j
        want += f"{word:016x}"
    assert fingerprints.fingerprints(docs).first().fingerprint == want


def test_block_tables_find_all_pairs_within_the_radius(spark):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(128) for _ in range(40)]
    values = set(base)
    for b in base:
        for flips in range(1, 6):
            v = b
            for bit in rng.sample(range(128), flips):
                v ^= 1 << bit
            values.add(v)
    texts = [f"{v:032x}" for v in values]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:5])], "doc_id long, fingerprint string")
    got = {(r.a, r.b): r.distance for r in fingerprints.near_fingerprints(found, radius=3).collect()}
    want = {}
    for a in texts:
        for b in texts:
            d = bin(int(a, 16) ^ int(b, 16)).count("1")
            if a < b and d <= 3:
                want[a, b] = d
    assert got == want
    near = {t: 0 for t in texts}
    for a, b in want:
        near[a] += 1 + (b in texts[:5])
        near[b] += 1 + (a in texts[:5])
    near = {t: n + (t in texts[:5]) for t, n in near.items()}
    assert {r.fingerprint: r.n_near for r in fingerprints.near_counts(found).collect()} == near
    with pytest.raises(ValueError):
        fingerprints.near_fingerprints(found, radius=5, blocks=5)


def test_prefix_sums_and_neighbours_cross_slices(spark):
    rows = [(g, k, 1 + k % 3) for g, n in ((0, 500), (1, 1), (2, 40)) for k in range(n)]
    frame = spark.createDataFrame(rows, "g int, k int, v int").repartition(7)
    got = {(r.g, r.k): r.before for r in shared.prefix_sums(frame, "g", [F.col("k")], "v").collect()}
    for g, k, _ in rows:
        assert got[g, k] == sum(v for h, j, v in rows if h == g and j < k)
    line = shared.neighbours(frame.select("k").distinct(), [F.col("k").desc()], ["k"])
    assert {(r.k, r.next_k) for r in line.collect()} == {(k, (k - 1) % 500) for k in range(500)}
