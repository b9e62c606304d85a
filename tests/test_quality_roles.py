import numpy as np
import pandas as pd
import pytest
from conftest import make_op, with_ids
from pyspark.sql import functions as F

from runwatch import check, infer_roles, split, stratified_split, subsample
from runwatch.operators import ordering, prepare, quality, quantiles, views
from runwatch.operators.roles import ColumnRoles, override_sensors, roles_frame


@pytest.fixture(scope="module")
def flat(spark):
    o = make_op(8, p=6, constant=True)
    return o, spark.createDataFrame(with_ids(o.nominal)), spark.createDataFrame(o.failures)


def test_check_finds_planted_trouble(flat, spark):
    o, df, _ = flat
    sensors = list(o.nominal.columns)
    q = check(df, ["op"], sensors)
    row = q.summary.first()
    assert row.constant == ["flat"] and row.n_rows == 1500 and row.duplicate_rows == 0
    pairs = {(r.kind, r.a, r.b) for r in q.pairs.collect()}
    assert ("duplicate", "t00", "t00_copy") in pairs and ("collinear", "t01", "t01_near") in pairs
    assert row.redundant == ["t00_copy", "t01_near"]
    assert row.effective_rank < row.n_sensors and np.isinf(row.condition_number)
    assert len(row.warnings) >= 4
    assert [r.sensor for r in q.affected().collect()] == ["flat"]
    cells = quality.correlation_cells(df, ["op"], sensors).toPandas()
    r = cells.pivot(index="i", columns="j", values="r").to_numpy()
    live = o.nominal.drop(columns="flat")
    assert np.allclose(r[:-1, :-1], np.corrcoef(live.to_numpy(), rowvar=False))
    assert (np.diag(r) == 1).all() and np.abs(r).max() <= 1 + 1e-9
    eig = np.array(row.eigenvalues)
    assert np.allclose(eig, np.linalg.eigvalsh(r[:-1, :-1])[::-1].clip(0), atol=1e-8)
    assert q.spectrum().count() == len(eig)


def test_dirty_values_are_counted(spark):
    inf = float("inf")
    rows = [(1.0, 2.0, "7"), (1.0, 2.0, "7"), (float("nan"), 3.0, "x"), (None, 4.0, "8"),
            (inf, 5.0, "9"), (-inf, 6.0, "1"), (2.5, 7.0, "2")]
    df = spark.createDataFrame([("A", *r) for r in rows], "op string, a double, b double, c string")
    t = {r.sensor: r for r in quality.sensor_counts(df, ["op"], ["a", "b", "c"]).collect()}
    assert (t["a"].missing, t["a"].non_finite, t["a"].constant) == (2, 4, False)
    assert (t["c"].missing, t["b"].non_finite) == (1, 0)
    q = check(df, ["op"], ["a", "b", "c"]).summary.first()
    assert (q.duplicate_rows, q.rows_non_finite, q.values_non_finite) == (1, 4, 5)


def test_drop_redundant_and_protect(flat):
    o, df, _ = flat
    sensors = list(o.nominal.columns)
    row = prepare.drop_redundant(df, ["op"], sensors).first()
    assert row.kept == o.names
    assert row.dropped == {"t00_copy": "t00", "t01_near": "t01", "flat": "(constant)"}
    kept = prepare.drop_redundant(df, ["op"], sensors, protect=["t00_copy"]).first().kept
    assert "t00_copy" in kept and "t00" in kept


def test_scalers(flat, spark):
    o, df, _ = flat
    names = o.names + ["flat"]
    std = prepare.fit_scaler(df, ["op"], names)
    row = std.first()
    assert np.allclose(row.center[:-1], o.nominal[o.names].mean())
    assert np.allclose(row.scale[:-1], o.nominal[o.names].std(ddof=0))
    assert row.degenerate == ["flat"] and row.scale[-1] == 1.0
    z = prepare.scale(df, std, ["op"], names)
    back = prepare.unscale(z, std, ["op"], names).select("run_id", *names).toPandas().sort_values("run_id")
    want = df.select("run_id", *names).toPandas().sort_values("run_id")
    assert np.allclose(back[names].to_numpy(), want[names].to_numpy())
    near = prepare.fit_scaler(df, ["op"], o.names, "robust").first()
    far = prepare.fit_scaler(df, ["op"], o.names, "robust", exact_rows=200).first()
    assert near.center == far.center and near.scale == far.scale
    assert np.allclose(near.center, o.nominal[o.names].median())


def test_noise_is_repeatable_and_scaled(flat):
    o, df, _ = flat
    a, b = (prepare.add_noise(df.repartition(n), ["op"], ["t02"], 0.5, seed=3)
            .select("run_id", "t02").toPandas().sort_values("run_id").t02.to_numpy() for n in (1, 5))
    assert np.allclose(a, b)
    x = df.select("run_id", "t02").toPandas().sort_values("run_id").t02.to_numpy()
    assert (a - x).std() == pytest.approx(0.5 * x.std(), rel=0.1)
    assert prepare.add_noise(df, ["op"], ["t02"], 0.0) is df


def test_role_inference(flat, spark):
    o, _, failures = flat
    nominal = spark.createDataFrame(o.nominal)
    roles = infer_roles(failures, nominal)
    assert (roles.label, roles.intensity) == ("Failure", "Intensity")
    assert "flat" in roles.excluded and roles.sensors == [c for c in o.nominal.columns if c != "flat"]
    given = infer_roles(failures, nominal, label="none", intensity="none", exclude=["t03"])
    assert given.label is None and given.intensity is None and "t03" in given.excluded
    assert "Failure" in given.meta
    keep = infer_roles(failures, nominal, drop_constant=False)
    assert "flat" in keep.sensors
    short = infer_roles(failures, nominal.drop("t02"))
    assert "t02" in short.excluded
    back = ColumnRoles.from_rows(roles_frame(spark, {"OP": roles}).collect())
    assert back.sensors == roles.sensors and back.label == roles.label
    assert override_sensors(roles, ["t04", "zzz", "t01"]).sensors == ["t04", "t01"]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one value is shared by a third of them."""
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 6000, p=[0.8, 0.19, 0.01]),
                        "v": np.round(rng.exponential(1, 6000) ** 5, 2)})
    pdf.loc[:2000, "v"] = 0.25
    pdf["run_id"] = [f"r{i}" for i in range(len(pdf))]
    return pdf, spark.createDataFrame(pdf).repartition(6).cache()


def test_narrowed_quantiles_equal_numpy(skewed, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(quantiles, "FINISH_ROWS", 20)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    near = quantiles.grouped_quantiles(df, ["g"], "v", probs).orderBy("g").collect()
    far = quantiles.grouped_quantiles(df, ["g"], "v", probs, exact_rows=30).orderBy("g").collect()
    for a, b in zip(near, far):
        assert a.n == b.n and a.q == b.q
        assert np.allclose(a.q, np.quantile(pdf.v[pdf.g == a.g], probs))


def test_cuts_and_bins_do_not_depend_on_bucket_size(skewed):
    pdf, df = skewed
    for fn in (
        lambda b: split(df, ["g"], test_size=0.25, bucket_rows=b),
        lambda b: ordering.rank_bins(df, ["g"], "v", n_bins=4, bucket_rows=b),
    ):
        near, far = (fn(b).toPandas().sort_values("run_id").reset_index(drop=True) for b in (None, 150))
        pd.testing.assert_frame_equal(near, far, check_like=True)
    s = split(df, ["g"], test_size=0.25).groupBy("g").agg(
        F.count_if("is_test").alias("k"), F.count("*").alias("n")).collect()
    assert all(r.k == round(0.25 * r.n) for r in s)
    sizes = subsample(df, ["g"], max_points=100).groupBy("g").count().collect()
    assert all(r["count"] == min(100, (pdf.g == r.g).sum()) for r in sizes)


def test_stratified_split(flat, spark):
    o, _, _ = flat
    pdf = with_ids(o.failures).rename(columns={"Failure": "class", "Intensity": "intensity"})
    got = stratified_split(spark.createDataFrame(pdf), ["op"], n_bins=5).toPandas()
    assert len(got) == len(pdf) and got.run_id.is_unique
    share = got.groupby("class").is_test.mean()
    assert (share - 0.3).abs().max() < 0.05
    means = got.groupby(["class", "is_test"]).intensity.mean().unstack()
    assert (means[True] - means[False]).abs().max() < 0.15 * pdf.intensity.std()
    tiny = spark.createDataFrame([("O", "1", "a", 1.0), ("O", "2", "a", 2.0), ("O", "3", "b", 3.0)],
                                 "op string, run_id string, class string, intensity double")
    small = stratified_split(tiny, ["op"], test_size=0.5).toPandas().set_index("run_id")
    assert len(small) == 3 and not small.loc["3"].is_test


def test_ellipse_and_pca(spark):
    rng = np.random.RandomState(4)
    xy = rng.multivariate_normal([1.0, -2.0], [[4.0, 1.2], [1.2, 1.0]], 4000)
    pdf = pd.DataFrame(xy, columns=["x", "y"])
    pdf["op"], pdf["set"], pdf["run_id"] = "E", "nominal", [str(i) for i in range(4000)]
    df = spark.createDataFrame(pdf)
    facts = views.ellipse_facts(df, "x", "y")
    pts = views.ellipse_points(facts, 3.0).toPandas()[["x", "y"]].to_numpy()
    cov = np.cov(xy, rowvar=False)
    gap = pts - xy.mean(0)
    assert np.allclose(np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap), 9.0)
    inside = views.inside_ellipse(df, facts, "x", "y").agg(F.avg(F.col("inside").cast("int"))).first()[0]
    assert inside == pytest.approx(1 - np.exp(-4.5), abs=0.006)
    pca = views.fit_pca(df, ["x", "y"])
    ratio = pca.first().ratio
    r = np.corrcoef(xy, rowvar=False)[0, 1]
    assert np.allclose(ratio, [(1 + r) / 2, (1 - r) / 2])
    var = views.project_pca(df, pca, ["x", "y"], ["run_id"]).agg(F.var_pop("pc1"), F.var_pop("pc2")).first()
    assert np.allclose(tuple(var), [1 + r, 1 - r])
