"""Order statistics of large groups: limits forced low, results compared with the built-in aggregate."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runwatch.operators import quantiles

PROBS = [0.0, 0.001, 0.25, 0.5, 1 / 3, 0.9, 0.999, 1.0]


def frame(spark, seed=0, n=6000):
    rng = np.random.default_rng(seed)
    heavy = np.exp(rng.normal(size=n) * 12) * rng.choice([-1, 1], n)
    parts = {"smooth": rng.normal(size=n), "heavy": heavy, "ties": np.round(rng.normal(size=n)),
             "flat": np.full(n, 3.25), "two": np.where(np.arange(n) < n // 2, -1e308, 1e308),
             "zeros": np.where(rng.random(n) < 0.7, rng.choice([0.0, -0.0], n), rng.normal(size=n)),
             "lone": rng.normal(size=1), "few": rng.normal(size=30)}
    pdf = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in parts.items()])
    pdf["c"] = rng.choice([1, 1, 1, 2, 500], len(pdf))
    none = pd.DataFrame({"g": [None, "smooth"], "v": [1.5, np.nan], "c": [1, 1]})
    df = spark.createDataFrame(pd.concat([pdf, none]), "g string, v double, c bigint")
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))).where("g is not null").repartition(7).cache()


@pytest.mark.parametrize("finish, weight", [(40, None), (200, "c")])
def test_narrowing_equals_the_builtin(spark, monkeypatch, finish, weight):
    monkeypatch.setattr(quantiles, "FINISH_ROWS", finish)
    monkeypatch.setattr(quantiles, "SKETCH_SIZE", 64)
    monkeypatch.setattr(quantiles, "MARGIN", 0.02)
    df = frame(spark)
    times = F.col("c") if weight else F.lit(1)
    want = {r["g"]: (r["n"], r["q"]) for r in df.where("v is not null").groupBy("g").agg(
        F.sum(times).alias("n"), F.percentile("v", F.array(*[F.lit(p) for p in PROBS]), times).alias("q")).collect()}
    got = {r["g"]: (r["n"], r["q"]) for r in quantiles.grouped_quantiles(
        df, ["g"], "v", PROBS, exact_rows=20, weight=weight).collect()}
    assert got.keys() == want.keys()
    for g, (n, q) in want.items():
        assert got[g][0] == n
        assert got[g][1] == pytest.approx(q, rel=1e-12, abs=1e-12), g


def test_a_misleading_sketch_costs_passes_only(spark, monkeypatch):
    """Margins of nothing leave most ranks outside their bounds."""
    monkeypatch.setattr(quantiles, "FINISH_ROWS", 100)
    monkeypatch.setattr(quantiles, "SKETCH_SIZE", 8)
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    df = frame(spark, 3, 2000)
    want = df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.37), F.lit(0.62))).alias("q"))
    got = quantiles.grouped_quantiles(df, ["g"], "v", [0.37, 0.62], exact_rows=0)
    wanted = {r["g"]: r["q"] for r in want.collect()}
    found = {r["g"]: r["q"] for r in got.collect()}
    assert found.keys() == wanted.keys() and all(found[g] == pytest.approx(q) for g, q in wanted.items())


def test_positions_tell_what_is_below_and_equal(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FINISH_ROWS", 25)
    rows = spark.range(0, 3000, 1, 6).select(
        F.lit("a").alias("g"), F.floor(F.col("id") / 100).cast("double").alias("_v"), F.lit(1).cast("bigint").alias("_c"))
    wanted = spark.createDataFrame([("a", 3000, i, float(p)) for i, p in enumerate([0, 99, 100, 1750, 2999])],
                                   "g string, n bigint, i int, pos double")
    got = {r["i"]: (r["x"], r["below"], r["ties"]) for r in quantiles.order_values(rows, ["g"], wanted).collect()}
    assert got == {i: (v, int(100 * v), 100) for i, v in enumerate([0.0, 0.0, 1.0, 17.0, 29.0])}


def test_a_far_tail_moves_few_rows(spark, monkeypatch):
    """The 1 - 1e-5 quantile of 400,000 scores: what is left to sort is under a hundredth."""
    seen = []
    real = quantiles._finish

    def spy(rows, keys, brackets, whole=False):
        seen.append((whole, brackets.agg(F.sum("_inside")).first()[0] or 0))
        return real(rows, keys, brackets, whole)

    monkeypatch.setattr(quantiles, "_finish", spy)
    monkeypatch.setattr(quantiles, "FINISH_ROWS", 4000)
    df = spark.range(0, 400_000, 1, 8).select(
        F.lit("a").alias("g"), (-F.log1p(-F.rand(5))).alias("v")).cache()
    p = 1 - 1e-5
    got = quantiles.grouped_quantiles(df, ["g"], "v", [p], exact_rows=1000).first()
    assert got["q"][0] == df.agg(F.percentile("v", p)).first()[0]
    assert sum(n for _, n in seen) < 4000
