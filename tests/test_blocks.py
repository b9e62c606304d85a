"""Runs meet models and scalings: every way the rows can take gives the same numbers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runwatch import runtime
from runwatch.operators import blocks, distance, gram

P = 12
AXIS = [f"s{j}" for j in range(P)]
WAYS = {"local": {}, "blocks": {"MODEL_BYTES": 0, "LOCAL_BYTES": 0},
        "salted": {"MODEL_BYTES": 0, "LOCAL_BYTES": 0, "BROADCAST_BYTES": 0, "BLOCK_BYTES": 900, "HELD_BYTES": 20_000}}


@pytest.fixture(params=list(WAYS))
def way(request, monkeypatch):
    for name, value in WAYS[request.param].items():
        for module in (blocks, distance, runtime):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, value)
    return request.param


def rows_of(seed=0, groups=17, n=700):
    """Runs of many groups; a third belong to the first, some are missing a value, some have no model."""
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.35, 0, rng.integers(0, groups + 2, n))
    x = rng.normal(size=(n, P)) * (1 + np.arange(P))
    x[rng.random(n) < 0.03, 4] = np.nan
    x[rng.random(n) < 0.02, 5] = np.inf
    pdf = pd.DataFrame(x, columns=AXIS)
    pdf.insert(0, "op", [None if v == groups + 1 else f"g{v}" for v in g])
    pdf.insert(0, "run_id", range(n))
    pdf["s7"] = pdf["s7"].map(str)
    pdf["s8"] = pdf["s8"].round().astype(int)
    return pdf


def models_of(seed=1, groups=17):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(groups):
        for chain in ("a", "b")[: 1 + k % 2]:
            use = (np.arange(P) % 5 != k % 5).tolist()
            rows.append((f"g{k}", chain, ["x", None][: 1 + k % 2], use, rng.normal(size=P).tolist(),
                         np.tril(rng.normal(size=(P, P))).ravel().tolist()))
    return rows


MODELS = "op string, chain string, tags array<string>, use array<boolean>, shift array<double>, weight array<double>"


def plain_scores(pdf, models):
    found = {}
    for r in pdf.itertuples(index=False):
        x = np.array([float(v) for v in r[2:]])
        x[~np.isfinite(x)] = np.nan
        for op, chain, _, use, shift, weight in models:
            if op == r.op:
                y = np.array(weight).reshape(P, P) @ np.where(use, x - np.array(shift), 0.0)
                found[r.run_id, chain] = None if np.isnan(y).any() else float(y @ y)
    return found


def test_distances(spark, way):
    pdf, models = rows_of(), models_of()
    df = spark.createDataFrame(pdf).repartition(5).withColumn("extra", F.create_map(F.lit("k"), F.col("run_id")))
    got = distance.distances(df, spark.createDataFrame(models, MODELS), AXIS, ["chain", "tags"], contributions=True)
    assert got.columns == [*df.columns, "chain", "tags", "d2", "parts"]
    want, seen = plain_scores(pdf, models), {}
    tags = {(m[0], m[1]): m[2] for m in models}
    for r in got.collect():
        seen[r["run_id"], r["chain"]] = r["d2"]
        assert r["tags"] == tags[r["op"], r["chain"]] and r["extra"] == {"k": r["run_id"]}
        assert (r["parts"] is None) == (r["d2"] is None)
        if r["parts"] is not None:
            assert len(r["parts"]) == P and sum(r["parts"]) == pytest.approx(r["d2"])
    assert seen.keys() == want.keys()
    for key, value in want.items():
        assert (seen[key] is None) == (value is None) and (value is None or seen[key] == pytest.approx(value))


def test_distances_of_a_stream(spark, way, tmp_path):
    pdf, models = rows_of(3, n=200), models_of()
    df = spark.createDataFrame(pdf)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    scored = distance.distances(stream, spark.createDataFrame(models, MODELS), AXIS, ["chain"])
    name = f"scores_{way}"
    query = scored.select("run_id", "chain", "d2").writeStream.format("memory").queryName(name).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["run_id"], r["chain"]): r["d2"] for r in spark.table(name).collect()}
    want = plain_scores(pdf, models)
    assert got.keys() == want.keys()
    assert all((got[k] is None) if v is None else got[k] == pytest.approx(v) for k, v in want.items())


@pytest.mark.parametrize("quartic", [False, True])
def test_standard_sums(spark, way, quartic):
    pdf = rows_of(5)
    pdf["s7"], pdf["held"] = pdf["s7"].astype(float), pdf["run_id"] % 3 == 0
    df = gram.clean(spark.createDataFrame(pdf).repartition(6), AXIS, ["op", "held"])
    rng = np.random.default_rng(2)
    stats = [(f"g{k}", rng.normal(size=P).tolist(), (1 + rng.random(P)).tolist(),
              (np.arange(P) % 4 != k % 4).tolist()) for k in range(17)]
    table = spark.createDataFrame(stats, "op string, center array<double>, scale array<double>, use array<boolean>")
    got = {(r["op"], r["held"]): np.array(r["acc"])
           for r in gram.standard_gram(df, table, ["op"], AXIS, quartic, by=["held"]).collect()}
    expected = set()
    for op, center, scale, use in stats:
        for held in (False, True):
            x = pdf[(pdf["op"] == op) & (pdf["held"] == held)][AXIS].to_numpy(float)
            x[~np.isfinite(x)] = np.nan
            z = np.where(use, (x - center) / scale, 0.0)
            if len(z):
                expected.add((op, held))
                assert np.allclose(got[op, held], gram.pack(z[~np.isnan(z).any(axis=1)], quartic))
    assert got.keys() == expected
    z = gram.standard_columns(df, table, ["op"], AXIS, keep=["held"])
    assert z.columns == ["held", *[f"z{j}" for j in range(P)]]
    plain = gram.gram(z.where("held"), ["held"], z.columns[1:], quartic).first()["acc"]
    assert np.allclose(plain, sum(v for (_, held), v in got.items() if held))


def test_many_sensors_stay_within_one_method(spark):
    """Ninety sensors: the expressions for their scaling would not fit into one generated method."""
    rng = np.random.default_rng(0)
    p, n = 90, 300
    x = rng.normal(size=(n, p))
    names = [f"s{j}" for j in range(p)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(op="a"))
    table = spark.createDataFrame([("a", [0.5] * p, [2.0] * p, [True] * p)],
                                  "op string, center array<double>, scale array<double>, use array<boolean>")
    made = gram.standard_gram(df, table, ["op"], names)
    assert "CASE WHEN" not in made._jdf.queryExecution().toString()
    assert np.allclose(made.first()["acc"], gram.pack((x - 0.5) / 2.0, False))


def test_a_salted_join_spreads_equal_rows(spark):
    rows = spark.range(0, 4000, 1, 16).select(F.lit("hot").alias("k"), F.create_map(F.lit(1), F.lit(2)).alias("m"))
    small = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    joined = runtime.attach(rows, small, ["k"], limit=0)
    assert joined.count() == 4000 and joined.select("v").distinct().collect()[0]["v"] == 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = joined.select(F.spark_partition_id().alias("t")).groupBy("t").count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks > 1
