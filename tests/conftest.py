"""Seeded inputs with known ground truth; everything else is Spark."""

from __future__ import annotations

import os
import sys
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("runwatch-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def gaussian(rng, p, n, mean=None, cov=None):
    if cov is None:
        a = rng.normal(size=(p, p))
        cov = a @ a.T + 0.5 * np.eye(p)
        mean = rng.uniform(10.0, 20.0, size=p)
    return rng.multivariate_normal(mean, cov, size=n), mean, cov


def make_op(seed, p=8, n_nominal=1500, classes=3, per_class=250, effect=0.12, top=40.0,
            redundant=True, constant=False):
    """Nominal cloud, faults that shift three sensors with intensity, planted copies."""
    rng = np.random.RandomState(seed)
    names = [f"t{i:02d}" for i in range(p)]
    x, mean, cov = gaussian(rng, p, n_nominal)
    sigma = np.sqrt(np.diag(cov))
    frames, truth = [], {}
    for c in range(classes):
        hit = rng.choice(p, size=3, replace=False)
        way = np.zeros(p)
        way[hit] = rng.choice([-1.0, 1.0], 3) * rng.uniform(0.6, 1.4, 3)
        way /= np.linalg.norm(way)
        level = rng.uniform(0.0, top, per_class)
        y = rng.multivariate_normal(mean, cov, size=per_class)
        y = y + level[:, None] * effect * (way * sigma)[None, :]
        f = pd.DataFrame(y, columns=names)
        f["Failure"], f["Intensity"] = f"K{c + 1}", level
        frames.append(f)
        truth[f"K{c + 1}"] = {"way": way * sigma * effect, "hit": {names[i] for i in hit},
                              "sign": dict(zip(names, np.sign(way)))}
    nominal, failures = pd.DataFrame(x, columns=names), pd.concat(frames, ignore_index=True)
    if redundant:
        for f in (nominal, failures):
            f["t00_copy"] = f["t00"]
            f["t01_near"] = f["t01"] + rng.normal(0.0, 0.02 * sigma[1], len(f))
    if constant:
        nominal["flat"] = failures["flat"] = 42.0
    return SimpleNamespace(nominal=nominal, failures=failures, names=names, mean=mean, cov=cov,
                           truth=truth)


def with_ids(pdf, op="OP", prefix="r"):
    out = pdf.copy()
    out["op"] = op
    out["run_id"] = [f"{op}-{prefix}-{i}" for i in range(len(out))]
    return out


@pytest.fixture(scope="session")
def op_pair():
    return make_op(7, p=8, classes=4)


@pytest.fixture(scope="session")
def pair_ds(spark, op_pair):
    from runwatch import Dataset

    return Dataset.from_frames(spark.createDataFrame(op_pair.nominal),
                               spark.createDataFrame(op_pair.failures), "OP")


@pytest.fixture(scope="session")
def two_ops(spark):
    """Two operating points in one dataset; the second lacks the last sensor."""
    from runwatch import Dataset
    from runwatch.operators.roles import ColumnRoles

    a, b = make_op(11, p=6, n_nominal=1200, per_class=200), make_op(12, p=6, n_nominal=1200, per_class=200)
    parts = []
    for name, o in (("OP_60", a), ("OP_80", b)):
        n = with_ids(o.nominal, name, "n")
        n["set"], n["class"], n["intensity"] = "nominal", None, np.nan
        f = with_ids(o.failures, name, "f").rename(columns={"Failure": "class", "Intensity": "intensity"})
        f["set"] = "failure"
        parts += [n, f]
    pdf = pd.concat(parts, ignore_index=True)
    sensors = list(a.nominal.columns)
    pdf.loc[pdf.op == "OP_80", "t05"] = np.nan
    pdf = pdf[["run_id", "op", "set", "class", "intensity", *sensors]]
    pdf["class"] = pdf["class"].astype(object).where(pdf["class"].notna(), None)
    runs = spark.createDataFrame(pdf, "run_id string, op string, set string, class string, "
                                 "intensity double, " + ", ".join(f"{s} double" for s in sensors))
    roles = {
        "OP_60": ColumnRoles(list(sensors), "class", "intensity"),
        "OP_80": ColumnRoles([s for s in sensors if s != "t05"], "class", "intensity"),
    }
    return SimpleNamespace(ds=Dataset(runs.cache(), roles), ops={"OP_60": a, "OP_80": b})


@pytest.fixture(scope="session")
def clean_gaussian(spark):
    rng = np.random.RandomState(3)
    train, mean, cov = gaussian(rng, 8, 20000)
    test, _, _ = gaussian(rng, 8, 20000, mean, cov)
    names = [f"g{i}" for i in range(8)]
    frame = lambda x, t: spark.createDataFrame(
        with_ids(pd.DataFrame(x, columns=names), "G", t)).repartition(8).cache()
    return SimpleNamespace(train=frame(train, "a"), test=frame(test, "b"), names=names,
                           mean=mean, cov=cov, test_values=test)
