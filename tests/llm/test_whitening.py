"""Whitening against a plain eigendecomposition and exact integer sums."""

import numpy as np
import pytest

from runwatch.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA).repartition(3)


def units(v):
    return [int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v]


@pytest.mark.parametrize("p, rank", [(1, 1), (2, 2), (7, 7), (33, 33), (40, 12)])
def test_factors_equal_a_plain_eigendecomposition(p, rank):
    rng = np.random.default_rng(p)
    a = rng.normal(size=(rank, p)) * np.exp(rng.normal(size=p))
    values, vectors = whitening.eigen(a.T @ a)
    assert len(values) == rank
    assert np.allclose(values, np.linalg.eigvalsh(a.T @ a)[::-1][:rank], rtol=1e-8)
    assert np.allclose(vectors @ vectors.T, np.eye(rank), atol=1e-12)
    assert np.allclose((vectors.T * values) @ vectors, a.T @ a, rtol=0, atol=1e-10 * values[0])


def test_pivots_fall_and_the_factor_gives_the_matrix_back():
    a = np.array([[1.0, 2, 0], [2, 9, 1], [0, 1, 4]])
    low, order = whitening.pivoted_cholesky(a)
    assert order[0] == 1 and (np.diff(np.diag(low)) <= 0).all() and np.allclose(np.triu(low, 1), 0)
    assert np.allclose(low @ low.T, a[order][:, order])
    assert whitening.pivoted_cholesky(np.zeros((3, 3)))[0].shape == (3, 0)


def test_rows_equal_a_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) * 0.2
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(7, rows[7][1]), (None, rows[8][1])]
    bad = [(900, None), (901, [None] + [0.0] * 11), (902, [float("nan")] + [0.0] * 11),
           (903, [float("inf")] + [0.0] * 11), (904, [])]
    got = whitening.whiten(table(spark, rows + bad)).collect()
    n = len(rows)
    whole = np.array([units(v) for _, v in rows], dtype=object)
    total = whole.sum(axis=0)
    centred = np.array([[float(c) for c in r] for r in whole * n - total]) / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == n * 8 and {(r["n"], type(r["identity_error"])) for r in got} == {(n, float)}
    assert max(r["identity_error"] for r in got) < 1e-9
    by_id: dict = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(cov), rel=1e-9)
    assert len(by_id[7][1]) == 2 and len(by_id[None][3]) == 1
    for k in range(1, 9):
        found = np.array([by_id[i][k][0]["whitened"] for i, _ in rows])
        want = centred @ v[:, k - 1] / np.sqrt(e[k - 1])
        assert np.allclose(found, want, atol=1e-7) or np.allclose(found, -want, atol=1e-7)
    for (i, _), r in zip(rows, whole):
        assert int(by_id[i][1][0]["deviation"]) == sum(int(d) ** 2 for d in r * n - total)


def test_no_rank_lengths_and_large_entries(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(table(spark, [(1, [0.5, 1.0])])).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"])
            for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whiten(table(spark, [(i, [float(i), 3.0, 2.0 * i]) for i in range(5)])).collect()
    assert len(flat) == 15
    for r in flat:
        assert (r["whitened"] is None) == (r["component"] > 1) and r["explained"] == pytest.approx(float(r["component"] == 1))
        assert r["identity_error"] < 1e-9
    mixed = whitening.whiten(table(spark, [(i, [float(i)] * (1 + i % 2)) for i in range(20)])).collect()
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in mixed) == sorted(
        (i, k + 1, 10) for i in range(20) for k in range(1 + i % 2))
    wide = [(i, [1e30 * (-1) ** i, float(i)]) for i in range(4)]
    huge = whitening.whiten(table(spark, wide)).collect()
    assert len(huge) == 8 and all(r["identity_error"] < 1e-6 for r in huge)
    far = [(i, [float(2**40 * (i % 3)), float(i)]) for i in range(6)]
    exact = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(table(spark, far)).collect()}
    whole = np.array([units(v) for _, v in far], dtype=object)
    want = [sum(int(d) ** 2 for d in r) for r in whole * 6 - whole.sum(axis=0)]
    assert [exact[i] for i in range(6)] == want
