"""What large tables need: rows computed once, filters that do not repeat a score, slots instead of sorts."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from runwatch.functions.columns import with_count
from runwatch.operators import binning, gram, ordering, quantiles
from runwatch.operators.binning import binned_stats
from runwatch.operators.distance import distances
from runwatch.operators.mcd import concentrate, nth_distances
from runwatch.operators.ordering import before_cut
from runwatch.operators.views import score_vs_intensity
from runwatch.runtime import materialise


def test_a_filter_on_the_score_does_not_repeat_it(spark):
    axis = ["a", "b", "c", "d"]
    rows = spark.createDataFrame([("x", 1.0, 2.0, 3.0, 4.0), ("x", 9.0, 0.0, 1.0, None)],
                                 "op string, a double, b double, c double, d double")
    model = spark.createDataFrame([("x", [True] * 4, [0.0] * 4, [float(v) for v in np.eye(4).ravel()])],
                                  "op string, use array<boolean>, shift array<double>, weight array<double>")
    made = distances(rows, model, axis, [], triangular=True, rows=1).withColumn("s", F.sqrt("d2"))
    kept = made.where(F.col("s") < 100)
    assert [r["d2"] for r in kept.collect()] == [30.0]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("_w0") for line in plan.splitlines()) <= 3, plan


def test_binned_stats_computes_its_rows_once(spark, tmp_path):
    n = 4000
    source = str(tmp_path / "source")
    pdf = pd.DataFrame({"g": ["u"] * n, "x": np.arange(n) % 37 * 1.0, "y": np.arange(n) * 1.0})
    spark.createDataFrame(pdf).write.parquet(source)
    for exact_rows in (None, 100):
        made = binned_stats(spark.read.parquet(source), ["g"], "x", "y", 5, exact_rows=exact_rows)
        assert not [f for f in made.inputFiles() if "/source/" in f]
        assert sum(r["n"] for r in made.collect()) == n


def test_entries_at_or_below_a_value(spark):
    lists = [[], [1.0], [1.0, 2.0, 4.0], [float(k) for k in range(11)]]
    values = [None, float("nan"), -1.0, 0.0, 1.0, 1.5, 2.0, 4.0, 10.0, 99.0]
    rows = spark.createDataFrame([(b, v) for b in lists for v in values], "b array<double>, v double")
    got = with_count(rows, "n", "b", "v", 11).collect()
    for r in got:
        above = r["v"] is not None and np.isnan(r["v"])
        assert r["n"] == (0 if r["v"] is None else sum(above or b <= r["v"] for b in r["b"]))


def test_nth_distances_by_slots(spark):
    rng = np.random.default_rng(3)
    d2 = np.concatenate([np.zeros(5), rng.chisquare(4, 3000), np.full(400, 2.5)])
    pdf = pd.DataFrame({"op": "a", "chain": "c0", "d2": d2})
    other = pd.DataFrame({"op": "a", "chain": "c1", "d2": d2 * 3})
    d = spark.createDataFrame(pd.concat([pdf, other]))
    for h in (1, 5, 6, 1702, 2000, len(d2)):
        ranks = spark.createDataFrame([("a", h)], "op string, h bigint")
        got = {r["chain"]: r["_cut"] for r in nth_distances(d, ranks, 2).collect()}
        assert got == {"c0": np.sort(d2)[h - 1], "c1": np.sort(d2 * 3)[h - 1]}


def test_stored_steps_hand_on_no_constraints(spark):
    before = spark.conf.get("spark.sql.constraintPropagation.enabled")
    made = materialise(spark.range(50).where("id > 3").withColumn("b", F.col("id") * 2))
    assert made._jdf.queryExecution().optimizedPlan().constraints().size() == 0
    assert made.count() == 46 and spark.conf.get("spark.sql.constraintPropagation.enabled") == before


def test_before_cut_makes_one_digest(spark):
    ids = spark.createDataFrame([(str(i),) for i in range(200)] + [(None,)], "run_id string")
    digest = F.md5(F.concat("run_id", F.lit("#0")))
    cut = ids.select(digest.alias("cut_hash"), F.col("run_id").alias("cut_id")).orderBy("cut_hash", "cut_id")
    cut = cut.where("cut_id is not null").limit(60).agg(
        F.max("cut_hash").alias("cut_hash"), F.max_by("cut_id", "cut_hash").alias("cut_id"))
    cut = materialise(cut)
    marked = ids.crossJoin(cut).where(before_cut(F.col("run_id"), 0))
    assert marked._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert marked.count() == 60 and marked.where("run_id is null").count() == 0
    none = ids.withColumns({"cut_hash": F.lit(None).cast("string"), "cut_id": F.lit(None).cast("string")})
    assert [r[0] for r in none.select(before_cut(F.col("run_id"), 0)).distinct().collect()] == [False]


def test_a_concentration_step_keeps_the_nearest_rows(spark):
    """Any bound on the rows that are sorted gives the same subset, ties at the cut included."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(900, 2)), np.full((300, 2), 0.9), np.zeros((40, 2))])
    z = spark.createDataFrame(pd.DataFrame(x, columns=["z0", "z1"]).assign(op="a", run_id="r")).repartition(3)
    one = np.eye(2).ravel().tolist()
    states = [("a", c, [True, True], s, one, one, 0.0, False) for c, s in (("c0", [0.0, 0.0]), ("c1", [0.5, -0.2]))]
    current = spark.createDataFrame(states, "op string, chain string, use array<boolean>, shift array<double>, "
                                    "weight array<double>, cov array<double>, logdet double, singular boolean")
    for h in (10, 700, 1240):
        ranks = spark.createDataFrame([("a", h)], "op string, h bigint")
        for most in (0, 50, 10_000):
            got = {r["chain"]: r for r in concentrate(z, current, ranks, ["z0", "z1"], 2, most).collect()}
            for _, c, _, shift, *_ in states:
                d2 = ((x - np.array(shift)) ** 2).sum(axis=1)
                kept = x[d2 <= np.sort(d2)[h - 1]]
                assert np.allclose(got[c]["shift"], kept.mean(axis=0), atol=1e-12)
                assert np.allclose(got[c]["cov"], np.cov(kept, rowvar=False, bias=True).ravel(), atol=1e-12)


def test_score_vs_intensity_scores_runs_once(spark):
    rows = [("a", "K", float(i), float(i % 7) if i % 5 else None, 2.0 + (i == 0)) for i in range(200)]
    frame = spark.createDataFrame(rows, "op string, class string, intensity double, s double, threshold double")
    frame = frame.select("op", "class", "intensity", "threshold", F.inline(F.array(F.struct(F.col("s").alias("score")))))
    made = score_vs_intensity(frame, n_bins=4)
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = made.collect()
    # the limit is over all runs, also those without a score
    assert sum(r["n"] for r in got) == 160 and {r["threshold"] for r in got} == {3.0}


def test_brackets_are_read_from_what_the_count_stored(spark, monkeypatch):
    """The scan that counts takes down the values next to the ranks; nothing after it reads all rows."""
    seen = []
    real = quantiles._finish

    def spy(rows, keys, brackets, whole=False):
        seen.append((whole, rows.count()))
        return real(rows, keys, brackets, whole)

    monkeypatch.setattr(quantiles, "_finish", spy)
    monkeypatch.setattr(quantiles, "FINISH_ROWS", 4000)
    df = spark.range(0, 300_000, 1, 4).select(F.lit("a").alias("g"), (F.rand(3) * 7).alias("v")).cache()
    probs = [0.0, 0.25, 0.5, 0.999]
    got = quantiles.grouped_quantiles(df, ["g"], "v", probs, exact_rows=1000).first()["q"]
    assert got == df.agg(F.percentile("v", F.array(*map(F.lit, probs)))).first()[0]
    assert seen and all(not whole and n < 20_000 for whole, n in seen)


def test_a_cut_is_read_from_what_the_count_stored(spark, monkeypatch):
    """Runs are hashed once, also where an id comes twice."""
    seen = []
    real = ordering.attach

    def spy(df, small, keys, *a, **k):
        if "left" in small.columns and "_inside" not in small.columns:
            seen.append(df.count())
        return real(df, small, keys, *a, **k)

    monkeypatch.setattr(ordering, "attach", spy)
    ids = spark.range(40_000).select(F.lit("a").alias("op"), F.col("id").cast("string").alias("run_id"))
    twice = ids.unionAll(ids)
    for df, n in ((ids, 40_000), (twice, 80_000)):
        k = int(n * 0.3)
        take = spark.createDataFrame([("a", n, k)], "op string, n bigint, k bigint")
        got = ordering.hash_cut(df, ["op"], "run_id", take, 7).first()
        want = sorted((hashlib.md5(f"{r[0]}#7".encode()).hexdigest(), r[0]) for r in df.select("run_id").collect())
        assert (got["cut_hash"], got["cut_id"]) == want[k - 1]
        assert seen.pop() <= 10_000


def test_rows_are_not_stored_again_with_their_bins(spark, monkeypatch):
    df = spark.range(6000).select(
        (F.col("id") % 2).cast("string").alias("g"), F.floor(F.rand(1) * 300).alias("_x").cast("double"),
        F.rand(2).alias("_y")).cache()
    want = binning.stats_in_bins(df, ["g"], 5).orderBy("g", "bin").collect()
    stores = []
    monkeypatch.setattr(binning, "stored", lambda rows: stores.append(rows) or rows)
    for bound in (2000, 100):
        got = binning.stats_in_bins(df, ["g"], 5, exact_rows=bound).orderBy("g", "bin")
        assert got.columns == ["g", "bin", "center", "lo", "hi", "median", "q25", "q75", "n"]
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want]
    assert not stores


def test_quartic_sums_of_seven_sensors_need_no_python(spark):
    rng = np.random.default_rng(2)
    names = [f"s{j}" for j in range(7)]
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(500, 7)), columns=names).assign(op="a"))
    stats = spark.createDataFrame(
        [("a", [0.1] * 7, [2.0] * 7, [True] * 6 + [False])],
        "op string, center array<double>, scale array<double>, use array<boolean>")
    made = gram.standard_gram(df, stats, ["op"], names, quartic=True)
    assert "Arrow" not in made._jdf.queryExecution().optimizedPlan().toString()
    z = (df.toPandas()[names].to_numpy() - 0.1) / 2.0
    z[:, 6] = 0.0
    assert np.allclose(made.first()["acc"], gram.pack(z, True))
