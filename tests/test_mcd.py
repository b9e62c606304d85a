"""Minimum covariance determinant: what wins in one part need not win over all rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from runwatch.operators.mcd import minimum_covariance_determinant


def test_a_cluster_that_wins_in_one_part_only_is_not_taken(spark):
    """800 of 3000 runs form a tight cluster, all in one of the two parts, where they are the majority."""
    rng = np.random.default_rng(1)
    part = spark.range(20_000).select(F.col("id").cast("string").alias("run_id")).withColumn(
        "part", F.pmod(F.xxhash64("run_id", F.lit("mcd0")), F.lit(2))).toPandas()
    first, second = (part[part["part"] == k]["run_id"].tolist() for k in (0, 1))
    cluster, cloud = first[:800], first[800:1500] + second[:1500]
    x = np.vstack([8 + 0.01 * rng.normal(size=(800, 3)), rng.normal(size=(2200, 3))])
    pdf = pd.DataFrame(x, columns=["z0", "z1", "z2"]).assign(op="a", run_id=cluster + cloud)
    lone = pd.DataFrame(rng.normal(size=(3, 3)), columns=["z0", "z1", "z2"]).assign(op="few", run_id=list("uvw"))
    z = spark.createDataFrame(pd.concat([pdf, lone])).select("op", "run_id", "z0", "z1", "z2")
    sizes = spark.createDataFrame([("a", 3000, [True] * 3), ("few", 3, [True] * 3)], "op string, n bigint, use array<boolean>")
    got = minimum_covariance_determinant(z, sizes, ["z0", "z1", "z2"], None, 0).collect()
    assert [r["op"] for r in got] == ["a"] and not got[0]["mcd_open"]
    assert np.abs(got[0]["mcd_mean"]).max() < 0.15
    # the reweighted rows are the cloud without its far tail
    assert np.allclose(np.array(got[0]["mcd_cov"]).reshape(3, 3), np.eye(3), atol=0.2)
