import numpy as np
import pandas as pd
import pytest
from conftest import make_op, with_ids
from pyspark.sql import functions as F

from runwatch import Detector, FittedDetector, FittedMahalanobis, Mahalanobis
from runwatch.functions.distributions import chi2_quantile, f_quantile, normal_quantile
from runwatch.operators import distance, gram


def one(df, *cols):
    return df.select(*cols).first()


def fpr(models, df):
    return models.false_positive_rate(df).first()["fpr"]


def test_inverse_distribution_pins():
    assert chi2_quantile(0.999, 24) == pytest.approx(51.17859777738163, rel=1e-10)
    assert f_quantile(0.999, 24, 2076) == pytest.approx(2.14745994438956, rel=1e-9)
    assert normal_quantile(0.975) == pytest.approx(1.959963984540054, rel=1e-12)
    assert chi2_quantile(0.5, 1) == pytest.approx(0.454936423119572, rel=1e-9)


@pytest.fixture(scope="module")
def fitted(clean_gaussian):
    return Mahalanobis(alpha=0.01).fit(clean_gaussian.train, clean_gaussian.names)


def test_distance_follows_chi2_and_rates_hold(fitted, clean_gaussian):
    d2 = fitted.squared_distance(clean_gaussian.test).select("run_id", "d2").toPandas()
    assert d2.d2.mean() == pytest.approx(8, rel=0.05)
    mine = fitted.squared_distance(clean_gaussian.test).select(*clean_gaussian.names, "d2").toPandas()
    gap = mine[clean_gaussian.names].to_numpy() - clean_gaussian.mean
    truth = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(clean_gaussian.cov), gap)
    assert np.corrcoef(truth, mine.d2)[0, 1] > 0.999
    for alpha in (0.05, 0.01, 0.001):
        share = float((mine.d2 > chi2_quantile(1 - alpha, 8)).mean())
        assert 0.4 * alpha < share < 2.5 * alpha
    row = one(fitted.table, "diagnostics.calibration_samples", "thresholds")
    assert row[0] == 6000
    assert set(row[1]) == {"chi2", "hotelling", "empirical"}
    values = np.array(list(row[1].values()))
    assert np.ptp(values) / values.mean() < 0.1
    assert fpr(fitted, clean_gaussian.test) == pytest.approx(0.01, abs=0.004)
    assert fitted.threshold_table().where("selected").count() == 1


def test_threshold_operations_return_new_tables(fitted, clean_gaussian):
    chi = fitted.use_threshold("chi2")
    row = one(chi.table, "threshold", "thresholds", "rule")
    assert row[0] == row[1]["chi2"] and row[2] == "chi2"
    assert one(fitted.table, "rule")[0] == "empirical"
    with pytest.raises(KeyError):
        fitted.use_threshold("nope")
    manual = fitted.set_threshold(3.25)
    assert one(manual.table, "threshold", "rule") == (3.25, "manual")
    again = fitted.calibrate(clean_gaussian.test, 0.05)
    assert fpr(again, clean_gaussian.test) == pytest.approx(0.05, abs=1e-3)
    far = fitted.calibrate(clean_gaussian.test, 0.05, exact_rows=500)
    assert one(far.table, "threshold")[0] == one(again.table, "threshold")[0]


def test_matches_a_numpy_ledoit_wolf(spark):
    rng = np.random.RandomState(5)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) + 7.0
    names = [f"v{i}" for i in range(5)]
    df = spark.createDataFrame(with_ids(pd.DataFrame(x, columns=names)))
    z = (x - x.mean(0)) / x.std(0)
    n, p = z.shape
    s = z.T @ z / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / n**2 / p, d2)
    cov = (1 - b2 / d2) * s + b2 / d2 * mu * np.eye(p)
    m = Mahalanobis(calib_fraction=0.0, threshold="chi2", ridge=None).fit(df, names)
    got = np.array(one(m.table, "precision")[0])
    assert np.allclose(got, np.linalg.inv(cov), rtol=1e-8)


def test_arrow_and_builtin_paths_agree(clean_gaussian, fitted, monkeypatch):
    monkeypatch.setattr(gram, "JVM_SENSORS", 0)
    monkeypatch.setattr(distance, "JVM_SENSORS", 0)
    other = Mahalanobis(alpha=0.01).fit(clean_gaussian.train, clean_gaussian.names)
    a, b = one(fitted.table, "threshold")[0], one(other.table, "threshold")[0]
    assert a == pytest.approx(b, rel=1e-9)
    parts = other.contributions(clean_gaussian.test.limit(50)).toPandas()
    assert np.allclose([sum(c) for c in parts.contribution], parts.score**2)


def test_result_does_not_depend_on_partitioning(clean_gaussian):
    one_part = Mahalanobis(alpha=0.01).fit(clean_gaussian.train.repartition(1), clean_gaussian.names)
    seven = Mahalanobis(alpha=0.01).fit(clean_gaussian.train.repartition(7), clean_gaussian.names)
    assert one(one_part.table, "threshold")[0] == pytest.approx(one(seven.table, "threshold")[0], rel=1e-10)


def test_redundant_sensors_are_dropped(spark, op_pair):
    df = spark.createDataFrame(with_ids(op_pair.nominal))
    m = Mahalanobis().fit(df, list(op_pair.nominal.columns))
    row = one(m.table, "features_used", "dropped", "diagnostics.condition_number")
    assert row[0] == op_pair.names
    assert row[1] == {"t00_copy": "t00", "t01_near": "t01"}
    assert np.isfinite(row[2])


def test_singular_covariance_and_truncation(spark, op_pair):
    df = spark.createDataFrame(with_ids(op_pair.nominal))
    sensors = list(op_pair.nominal.columns)
    raw = Mahalanobis(drop_redundant_sensors=False, cov="empirical").fit(df, sensors)
    assert raw.score(df).where("score is null or isnan(score)").count() == 0
    assert one(raw.table, "diagnostics.effective_rank")[0] < len(sensors)
    cut = Mahalanobis(drop_redundant_sensors=False, cov="empirical", inverse="eigen").fit(df, sensors)
    d = one(cut.table, "diagnostics.n_components", "diagnostics.effective_rank", "warnings")
    assert d[0] == d[1] < len(sensors) and any("truncated" in w for w in d[2])
    parts = cut.contributions(df).select(
        F.abs(F.aggregate("contribution", F.lit(0.0), lambda a, b: a + b) - F.col("score") ** 2)
        .alias("gap")).agg(F.max("gap")).first()[0]
    assert parts < 1e-8


def test_var_explained_sets_the_rank(clean_gaussian):
    rank = lambda v: one(Mahalanobis(
        inverse="eigen", var_explained=v).fit(clean_gaussian.train, clean_gaussian.names).table,
        "diagnostics.n_components")[0]
    assert rank(0.7) < rank(0.999) <= 8


@pytest.mark.parametrize("cov", ["empirical", "ledoit_wolf", "oas", "diagonal", "mcd"])
def test_every_estimator_separates(cov, pair_ds):
    op = pair_ds["OP"]
    m = Mahalanobis(cov=cov, scaler="robust").fit(op.nominal, op.sensors)
    nom, fail = (m.score(x).agg(F.avg("score"), F.count_if(F.col("score").isNull())).first()
                 for x in (op.nominal, op.failures))
    assert fail[0] > nom[0] and nom[1] == fail[1] == 0


def test_mcd_resists_contamination(spark):
    o = make_op(31, p=5, n_nominal=2000, redundant=False)
    rng = np.random.RandomState(1)
    dirty = o.nominal.copy()
    bad = rng.choice(len(dirty), 100, replace=False)
    dirty.iloc[bad] += 25.0 * np.sqrt(np.diag(o.cov)) * rng.normal(size=(100, 5))
    df, good = spark.createDataFrame(with_ids(dirty)), spark.createDataFrame(with_ids(o.nominal))
    gap = o.nominal.to_numpy() - o.mean
    truth = np.sqrt(np.einsum("ij,jk,ik->i", gap, np.linalg.inv(o.cov), gap)).mean()
    ratio = lambda **k: Mahalanobis(threshold="chi2", **k).fit(df, o.names).score(good).agg(
        F.avg("score")).first()[0] / truth
    assert ratio(cov="empirical") < 0.8
    assert 0.9 < ratio(cov="mcd", scaler="robust") < 1.12


def test_too_few_rows_for_mcd_falls_back(spark):
    rng = np.random.RandomState(2)
    names = [f"q{i}" for i in range(9)]
    df = spark.createDataFrame(with_ids(pd.DataFrame(rng.normal(size=(8, 9)), columns=names)))
    m = Mahalanobis(cov="mcd", calib_fraction=0.0, drop_redundant_sensors=False).fit(df, names)
    warnings = one(m.table, "warnings")[0]
    assert any("Ledoit-Wolf" in w for w in warnings) and any("samples per sensor" in w for w in warnings)
    assert one(m.table, "rule")[0] == "chi2" and any("unavailable" in w for w in warnings)


def test_contributions_are_exact_and_point_at_the_fault(pair_ds, op_pair):
    op = pair_ds["OP"]
    m = Mahalanobis().fit(op.nominal, op.sensors)
    rows = m.contribution_rows(op.failures, ["run_id", "class"])
    sums = rows.groupBy("run_id").agg(F.sum("contribution").alias("c"), F.sum("share").alias("s"),
                                      F.first("score").alias("score")).toPandas()
    assert np.allclose(sums.c, sums.score**2) and np.allclose(sums.s, 1.0)
    strong = op.failures.where("intensity > 30")
    best = (m.contribution_rows(strong, ["run_id", "class"]).groupBy("class", "sensor")
            .agg(F.avg("share").alias("share")).toPandas())
    for cls, part in best.groupby("class"):
        top = set(part.nlargest(4, "share").sensor)
        assert top & op_pair.truth[cls]["hit"]
    long = m.contribution_rows(op.failures, ["run_id", "class"])
    for hot, limit in ((False, None), (True, None), (True, 5.0)):
        some = long if not hot else long.where(F.col("score") > (F.col("threshold") if limit is None else F.lit(limit)))
        want = some.groupBy("class", "sensor").agg(F.avg("contribution").alias("c"), F.avg("share").alias("s"),
                                                   F.count("*").alias("n")).toPandas().sort_values(["class", "sensor"])
        got = m.contribution_means(op.failures, ["class"], hot, limit).toPandas().sort_values(["class", "sensor"])
        assert got["sensor"].tolist() == want["sensor"].tolist() and got["n"].tolist() == want["n"].tolist()
        assert np.allclose(got["contribution"], want["c"]) and np.allclose(got["share"], want["s"])
    table = m.top_contributors(op.failures.limit(5), 3).toPandas()
    assert len(table) == 5 and {"sensor_1", "share_3"} <= set(table.columns)
    assert (table.share_1 >= table.share_2).all() and (table.share_2 >= table.share_3).all()


def test_scoring_by_name_and_missing_sensor(pair_ds):
    op = pair_ds["OP"]
    m = Mahalanobis().fit(op.nominal, op.sensors)
    a = m.score(op.nominal).select("run_id", "score").toPandas().set_index("run_id").score
    turned = op.nominal.select("op", "run_id", *reversed(op.sensors), F.lit(1.0).alias("other"))
    b = m.score(turned).select("run_id", "score").toPandas().set_index("run_id").score
    assert np.allclose(a.sort_index(), b.sort_index())
    with pytest.raises(Exception):
        m.score(op.nominal.drop(op.sensors[2])).collect()
    flags = m.predict(op.failures).where("flagged <> (score > threshold)").count()
    assert flags == 0


def test_incomplete_rows_are_ignored_and_scored_as_missing(spark, op_pair):
    pdf = with_ids(op_pair.nominal)
    pdf.loc[:9, "t02"] = np.nan
    df = spark.createDataFrame(pdf)
    m = Mahalanobis(alpha=0.01).fit(df, op_pair.names)
    row = one(m.table, "diagnostics.n_train", "diagnostics.calibration_samples", "warnings")
    assert row[0] + row[1] == len(pdf) - 10 and any("incomplete rows" in w for w in row[2])
    scored = m.predict(df)
    assert scored.where("score is null").count() == 10
    assert scored.where("score is null and flagged").count() == 0


def test_save_and_load(pair_ds, spark, tmp_path):
    op = pair_ds["OP"]
    m = Mahalanobis().fit(op.nominal, op.sensors)
    path = m.save(str(tmp_path / "m"))
    back = FittedMahalanobis.load(spark, path)
    a, b = (x.score(op.failures).agg(F.sum("score")).first()[0] for x in (m, back))
    assert a == pytest.approx(b, rel=1e-12)
    assert one(back.table, "threshold", "features_used") == one(m.table, "threshold", "features_used")
    assert spark.read.json(f"{path}/models.json").first()["op"] == "OP"


@pytest.mark.parametrize("bad", [
    {"cov": "x"}, {"inverse": "x"}, {"threshold": "x"}, {"alpha": 0.0}, {"alpha": 1.0},
    {"calib_fraction": 1.0}, {"scaler": "x"}, {"ridge": "x"},
])
def test_bad_arguments(bad):
    with pytest.raises(ValueError):
        Mahalanobis(**bad)


def test_refuses_unusable_input(spark):
    flat = with_ids(pd.DataFrame({"a": [1.0] * 3, "b": [2.0] * 3}))
    with pytest.raises(ValueError):
        Mahalanobis().fit(spark.createDataFrame(flat), ["a", "b"])
    with pytest.raises(KeyError):
        Mahalanobis().fit(spark.createDataFrame(flat), ["a", "zzz"])


def test_user_detector_plugs_in(spark, clean_gaussian):
    from dataclasses import dataclass

    @dataclass(frozen=True)
    class FittedPeak(FittedDetector):
        def score(self, df):
            return df.join(F.broadcast(self.table.select("op", "chain", "threshold", "mid")), "op") \
                .withColumn("score", F.abs(F.col("g0") - F.col("mid")))

    class Peak(Detector):
        def fit(self, nominal, sensors, run_id="run_id", available=None):
            table = nominal.groupBy("op").agg(F.avg("g0").alias("mid")).withColumns({
                "chain": F.lit("peak"), "threshold": F.lit(1e9), "rule": F.lit("none"),
                "alpha": F.lit(0.5), "warnings": F.array().cast("array<string>"),
                "thresholds": F.create_map(F.lit("none"), F.lit(1e9))})
            return FittedPeak(table)

    m = Peak().fit(clean_gaussian.train, ["g0"]).calibrate(clean_gaussian.train, 0.1)
    assert fpr(m, clean_gaussian.test) == pytest.approx(0.1, abs=0.02)
