import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runwatch import Mahalanobis, ModelBank, detectability_summary, fit_pod, pod_analysis, score_frame
from runwatch.functions.distributions import normal_quantile
from runwatch.operators import logistic, views
from runwatch.operators.binning import binned_stats
from runwatch.operators.detectability import wilson

SLOPE, I50 = 3.0, 10.0


def sweep(seed, n, lo, hi, cls):
    rng = np.random.RandomState(seed)
    x = np.exp(rng.uniform(np.log(lo), np.log(hi), n))
    p = 1 / (1 + np.exp(-SLOPE * np.log(x / I50)))
    return pd.DataFrame({"op": "P", "class": cls, "intensity": x, "detected": rng.uniform(size=n) < p})


@pytest.fixture(scope="module")
def pods(spark):
    """One job for every edge state: classes of very different kinds side by side."""
    grid = np.exp(np.linspace(np.log(5), np.log(50), 500))
    flat = lambda c, hit: pd.DataFrame(
        {"op": "P", "class": c, "intensity": grid, "detected": hit})
    mixed = sweep(4, 1000, 1, 200, "mixed")
    mixed.loc[:49, "intensity"] = 0.0
    mixed.loc[50:99, "intensity"] = np.nan
    empty = pd.DataFrame({"op": "P", "class": "empty", "intensity": [np.nan, 0.0], "detected": [True, False]})
    frame = pd.concat([
        sweep(2, 20000, 1, 200, "big"), sweep(3, 1000, 1, 200, "small"), sweep(5, 4000, 1, 5, "short"),
        flat("always", True), flat("never", False), mixed, empty,
    ], ignore_index=True)
    df = spark.createDataFrame(frame).repartition(8).cache()
    pod = fit_pod(df)
    return df, pod, pod.result.toPandas().set_index("class")


def notes(row):
    return " ".join(row.notes)


def test_recovers_the_known_curve(pods):
    _, _, t = pods
    big = t.loc["big"]
    i90 = I50 * 9 ** (1 / SLOPE)
    assert big.i50 == pytest.approx(I50, rel=0.06) and big.i90 == pytest.approx(i90, rel=0.08)
    assert big.b1 == pytest.approx(SLOPE, rel=0.05)
    # ten bins over two and a half decades of ln x: centres are a factor 1.7 apart
    assert big.i90 / 1.7 < big.i90_emp < big.i90 * 1.7
    assert big.i90 <= big.i90_95 < 1.1 * big.i90


def test_bound_tightens_with_data(pods):
    _, _, t = pods
    gap = lambda c: t.loc[c].i90_95 / t.loc[c].i90 - 1
    assert 0 < gap("big") < gap("small")


def test_edge_states(pods):
    _, _, t = pods
    assert t.loc["always"].state == "always detected" and t.loc["always"].separated
    assert pd.isna(t.loc["always"].i90) and "always" in notes(t.loc["always"])
    assert t.loc["never"].state == "never detected" and not t.loc["never"].fitted
    assert pd.isna(t.loc["never"].b0) and "never" in notes(t.loc["never"])
    assert t.loc["short"].i90 > t.loc["short"].i_max and "extrapolation" in notes(t.loc["short"])
    assert t.loc["mixed"].n == 900
    assert "zero intensity left out: 50" in notes(t.loc["mixed"])
    assert "without intensity left out: 50" in notes(t.loc["mixed"])
    assert t.loc["empty"].state == "no data" and t.loc["empty"].n == 0


def test_table_puts_missing_first_and_bins_are_monotone(pods):
    _, pod, _ = pods
    table = pod.table().toPandas()
    known = table.i90.dropna()
    assert table.i90.isna().to_numpy()[: len(table) - len(known)].all()
    assert known.is_monotonic_decreasing
    bins = pod.bins.where("class = 'big'").orderBy("center").toPandas()
    assert len(bins) == 10 and bins.rate.iloc[-1] > bins.rate.iloc[0]
    assert ((bins.ci_lo <= bins.rate) & (bins.rate <= bins.ci_hi)).all()
    assert bins.n.sum() == 20000
    curve = pod.curve().where("class = 'big'").orderBy("point").toPandas()
    assert len(curve) == 200 and curve.pod.is_monotonic_increasing


def test_distributed_fit_equals_the_local_one(pods):
    df, _, t = pods
    few = df.where("class in ('small', 'short')")
    far = fit_pod(few, n_boot=30, cells_per_task=10, exact_rows=100).result.toPandas().set_index("class")
    near = fit_pod(few, n_boot=30).result.toPandas().set_index("class")
    for c in ("small", "short"):
        for name in ("b0", "b1", "i50", "i90", "i90_95", "i90_emp"):
            a, b = far.loc[c][name], near.loc[c][name]
            assert (pd.isna(a) and pd.isna(b)) or a == pytest.approx(b, rel=1e-7), (c, name)


def test_replicates_give_the_bound(pods):
    df, _, _ = pods
    few = df.where("class in ('small', 'short', 'never')")
    for limit in (None, 10):
        pod = fit_pod(few, n_boot=40, cells_per_task=limit)
        draws = pod.replicates().toPandas()
        bounds = pod.result.toPandas().set_index("class").i90_95
        assert draws.groupby("class").size().to_dict() == {"small": 40, "short": 40}
        for c, part in draws.groupby("class"):
            assert sorted(part.replicate) == list(range(1, 41))
            assert np.quantile(part.i90.dropna(), 0.95) == pytest.approx(bounds[c])


def test_replicates_settle_in_few_rounds_from_the_fit_of_the_data(spark, monkeypatch):
    rng = np.random.RandomState(1)
    x = rng.uniform(0, 5, 3000)
    y = (rng.rand(3000) < 1 / (1 + np.exp(-3 * (x - np.log(10))))).astype(float)
    cell = rng.randint(-2**62, 2**62, 3000)
    ones = np.ones(3000)
    rounds = []
    real = logistic.solve_step
    monkeypatch.setattr(logistic, "solve_step", lambda sums: rounds.append(len(sums)) or real(sums))
    beta, ok = logistic.fit_cells(x, cell, ones, y, 100)
    assert ok.all() and sum(n > 1 for n in rounds) + 1 < 10
    runs, hits = logistic.replicate_weights(cell, ones, y, np.arange(1, 101))
    cold, fine = logistic._iterate(x, runs, hits, np.zeros((100, 2)))
    assert fine.all() and np.allclose(beta[1:], cold, rtol=1e-7)


def test_evaluate(pods, spark):
    _, pod, t = pods
    grid = spark.createDataFrame([("P", "big", float(t.loc["big"].i90)), ("P", "big", 0.0),
                                  ("P", "never", 5.0)], "op string, class string, intensity double")
    got = [r.pod for r in pod.evaluate(grid).orderBy("class", F.desc("intensity")).collect()]
    assert got[0] == pytest.approx(0.9) and got[1] is None and got[2] is None


def test_poisson_weights_and_irls():
    rng = np.random.RandomState(0)
    cell = rng.randint(-2**62, 2**62, 4000)
    ones = np.ones(4000)
    runs, hits = logistic.replicate_weights(cell, ones * 7, ones * 3, np.arange(51))
    assert (runs[:, 0] == 7).all() and (hits[:, 0] == 3).all()
    assert hits[:, 1:].mean() == pytest.approx(3, abs=0.02) and hits[:, 1:].var() == pytest.approx(3, rel=0.03)
    assert abs(np.corrcoef(hits[:, 1], hits[:, 2])[0, 1]) < 0.06
    x = rng.uniform(-2, 2, 4000)
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))).astype(float)
    beta, ok = logistic.fit_cells(x, cell, ones, y, 0)
    assert ok[0] and beta[0] == pytest.approx([0.5, 1.5], rel=0.15)


def test_wilson(spark):
    rows = [(0, 20), (20, 20), (5, 20), (0, 0)]
    df = spark.createDataFrame(rows, "k bigint, n bigint")
    lo, hi = wilson(F.col("k"), F.col("n"))
    got = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert got[0].lo == 0.0 and 0 < got[0].hi < 0.25 and got[1].hi == 1.0
    z, p = normal_quantile(0.975), 0.25
    mid = (p + z * z / 40) / (1 + z * z / 20)
    half = z * np.sqrt(p * (1 - p) / 20 + z * z / 1600) / (1 + z * z / 20)
    assert (got[2].lo, got[2].hi) == pytest.approx((mid - half, mid + half))
    assert got[3].lo is None and got[3].hi is None


@pytest.fixture(scope="module")
def bank(two_ops):
    return ModelBank.fit(two_ops.ds, Mahalanobis(threshold="chi2", alpha=0.01))


def test_bank_routes_by_operating_point(bank, two_ops):
    ds = two_ops.ds
    t = bank.models.table.select("op", "features_in", "features_used", "center").toPandas().set_index("op")
    assert set(t.index) == {"OP_60", "OP_80"} and len(bank) == 2 and "OP_60" in bank
    assert "t05" in t.loc["OP_60"].features_used and "t05" not in t.loc["OP_80"].features_in
    assert "t05" not in t.loc["OP_80"].features_used
    scored = bank.score_dataset(ds)
    rates = views.detection_rates(scored).toPandas()
    assert (rates.nominal_rate < 0.05).all() and (rates.failure_rate > rates.nominal_rate).all()
    assert scored.where("score is null").count() == 0
    assert {r[0] for r in scored.where("set = 'nominal'").select("class").distinct().collect()} == {"NOMINAL"}
    with pytest.raises(KeyError):
        bank["nope"]
    with pytest.raises(KeyError):
        bank.check_known(ds.runs.withColumn("op", F.lit("other")))
    assert ds.common_sensors() == [s for s in ds.all_sensors() if s != "t05"]
    assert bank.to_frame().count() == 2
    with pytest.raises(KeyError):
        ModelBank.fit(ds, Mahalanobis(), sensors=ds.all_sensors())


def test_score_frame_and_alpha(bank, two_ops):
    runs = two_ops.ds.runs
    frame = score_frame(bank.models, runs, at_alpha=[0.05, 0.0005])
    own = score_frame(bank.models, runs)
    assert own.count() * 2 == frame.count()
    assert own.where("detected <> (score > threshold)").isEmpty()
    rates = frame.groupBy("alpha").agg(F.avg(F.col("detected").cast("int"))).collect()
    assert dict(map(tuple, rates))[0.05] > dict(map(tuple, rates))[0.0005]
    assert bank.models.table.where("rule <> 'chi2'").isEmpty()
    with pytest.raises(ValueError):
        score_frame(bank.models, runs.drop("intensity"))


def test_analysis_covers_every_class(bank, two_ops):
    table = detectability_summary(bank, two_ops.ds, n_boot=0)
    assert table.select("op", "class").distinct().count() == 6
    loose = pod_analysis(bank.models, two_ops.ds.runs, at_alpha=[0.05, 0.001], n_boot=0).result.toPandas()
    wide = loose.pivot(index=["op", "class"], columns="alpha", values="i90").dropna()
    assert len(wide) and (wide[0.05] <= wide[0.001] * 1.02).all()


def test_sensitivity_finds_the_affected_sensors(two_ops):
    t = views.sensor_sensitivity(two_ops.ds.runs, ["t00", "t01", "t02", "t03", "t04"]).toPandas()
    o = two_ops.ops["OP_60"]
    for cls, part in t[t.op == "OP_60"].groupby("class"):
        hit = o.truth[cls]["hit"] - {"t05"}
        top = part.iloc[0]
        assert top.sensor in hit and np.sign(top.slope) == o.truth[cls]["sign"][top.sensor]
        assert part[part.sensor.isin(hit)].r.abs().max() > part[~part.sensor.isin(hit)].r.abs().max()


def test_binned_stats(spark):
    x = np.linspace(0, 10, 2000)
    y = 3 * x + np.random.RandomState(0).normal(0, 0.1, 2000)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": x, "y": y}))
    t = binned_stats(df, ["g"], "x", "y", 10).orderBy("center").toPandas()
    assert len(t) == 10 and t["median"].is_monotonic_increasing and (t.q75 >= t.q25).all()
    far = binned_stats(df, ["g"], "x", "y", 10, exact_rows=50).orderBy("center").toPandas()
    pd.testing.assert_frame_equal(t, far)
    same = binned_stats(df.withColumn("x", F.lit(1.0)), ["g"], "x", "y", 5).toPandas()
    assert len(same) == 1 and same.n.iloc[0] == 2000
    assert binned_stats(df.limit(0), ["g"], "x", "y").count() == 0
