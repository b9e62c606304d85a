"""Random cuts found digit by digit, against sorting every hash."""

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from runwatch.operators import ordering


def test_cuts_equal_sorting(spark):
    ids = [("hot", f"r{i}") for i in range(3000)] + [("cold", f"c{i}") for i in range(40)]
    ids += [("same", "x")] * 50 + [("same", f"y{i}") for i in range(20)] + [(None, "z")]
    df = spark.createDataFrame(ids, "g string, run_id string").repartition(5).cache()
    order = {}
    for g, i in ids:
        order.setdefault(g, []).append((hashlib.md5(f"{i}#7".encode()).hexdigest(), i))
    for share in (0.0, 0.001, 0.3, 0.77, 1.0):
        take = df.where("g is not null").groupBy("g").agg(F.count("*").alias("n")).withColumn(
            "k", F.floor(F.col("n") * share).cast("bigint")).cache()
        for rows in (None, 3, 100):
            got = {r["g"]: (r["cut_hash"], r["cut_id"]) for r in
                   ordering.hash_cut(df, ["g"], "run_id", take, 7, bucket_rows=rows).collect()}
            want = {r["g"]: sorted(order[r["g"]])[r["k"] - 1] for r in take.collect() if r["k"] >= 1}
            assert got == want, (share, rows)


def test_no_window_holds_more_than_a_bucket(spark, monkeypatch):
    """One operating point of 60,000 runs: the rows that reach the window are those of one bucket."""
    seen = []
    real = ordering.attach

    def spy(df, small, keys, *a, **k):
        out = real(df, small, keys, *a, **k)
        if "left" in small.columns and "_inside" not in small.columns:
            here = out.where(F.startswith("_h", "_head"))
            seen.append(here.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
        return out

    monkeypatch.setattr(ordering, "attach", spy)
    df = spark.range(60_000).select(F.lit("a").alias("op"), F.col("id").cast("string").alias("run_id"))
    made = ordering.split(df, ["op"], test_size=0.3)
    assert made.where("is_test").count() == 18_000
    assert max(seen) <= ordering.BUCKET_ROWS


def test_bins_of_one_large_group(spark):
    """Ranks through a value that a third of the rows share, with limits that force every way."""
    df = spark.range(4000).select(
        F.lit("a").alias("g"), F.col("id").cast("string").alias("run_id"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") % 97).cast("double")).alias("v")).cache()
    h = ordering.hash_order(F.col("run_id"), 0)
    rank = F.row_number().over(Window.partitionBy("g").orderBy("v", h, "run_id"))
    want = df.withColumn("r", rank).select("run_id", F.greatest(
        F.ceil((F.col("r") - 1) * 8 / 3999) - 1, F.lit(0)).cast("bigint").alias("want"))
    for rows in (None, 500, 20):
        got = ordering.rank_bins(df, ["g"], "v", n_bins=8, bucket_rows=rows).join(want, "run_id")
        assert got.where("bin != want").count() == 0 and got.count() == 4000
