import json
import os

import numpy as np
import pandas as pd
import pytest
from conftest import make_op, with_ids
from pyspark.sql import functions as F

from runwatch import (
    Dataset, Mahalanobis, ModelBank, catalog_runs, detection_report, quicklook, read_failures,
    read_manifest, read_nominal, read_runs, score_stream, write_manifest,
)
from runwatch.sources import catalog
from runwatch.sources.tables import SENSOR_NAMES


def put(path, pdf):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    pdf.to_csv(path, index=False)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake") / "data")
    for i, name in enumerate(("OP_60", "OP_80")):
        o = make_op(40 + i, p=4, n_nominal=300, classes=2, per_class=120)
        put(f"{root}/{name}_nominal.csv", o.nominal)
        put(f"{root}/{name}_failures.CSV", o.failures)
    put(f"{root}/notes.csv", pd.DataFrame({"a": [1, 2]}))
    return root


def test_catalog_and_manifest(spark, folder, tmp_path):
    m = catalog_runs(spark, folder)
    assert m["operating_points"] == {
        n: {"nominal": f"{n}_nominal.csv", "failures": f"{n}_failures.CSV"} for n in ("OP_60", "OP_80")}
    assert m["unmatched"] == ["notes.csv"] and m["root"] == folder
    path = write_manifest(spark, m, str(tmp_path / "manifest"))
    assert read_manifest(spark, path) == m
    with open(tmp_path / "plain.json", "w") as fh:
        json.dump({**m, "root": "../x"}, fh)
    assert read_manifest(spark, str(tmp_path / "plain.json"))["root"] == os.path.normpath(f"{tmp_path}/../x")


def test_pairing_rules(spark):
    paths = [
        "/r/OP_60/nominal.csv", "/r/OP_60/nominal_vs_failures.csv",          # one of each: by folder
        "/r/mix/A1_base.csv", "/r/mix/A1_ko.csv", "/r/mix/B2_ref.csv", "/r/mix/B2_guasto.CSV",
        "/r/mix/C3_ok.csv",                                                   # half a pair
        "/r/mix/D4_sano.csv", "/r/mix/D4_nom.csv", "/r/mix/D4_fail.csv",      # two nominal files
        "/r/mix/readme.csv", "/r/OP/60/nominal.csv", "/r/OP/60/tablefailures.csv",
        "/r/engine_x_nominal.csv", "/r/engine_x_faults.csv",
    ]
    got = catalog.pair_files(spark.createDataFrame([(p,) for p in paths], "path string"), "/r").toPandas()
    pairs = got[got.status == "paired"].set_index("name")
    assert set(pairs.index) == {"OP_60", "OP_60_2", "A1", "B2", "D4", "engine_x"}
    assert pairs.loc["OP_60"].failures in ("OP_60/nominal_vs_failures.csv", "OP/60/tablefailures.csv")
    assert pairs.loc["D4"].nominal == "mix/D4_sano.csv"
    rest = got[got.status != "paired"]
    assert dict(zip(rest.nominal.fillna(rest.failures), rest.status)) == {
        "mix/C3_ok.csv": "half", "mix/D4_nom.csv": "replaced", "mix/readme.csv": "unknown"}
    files = pairs[["nominal", "failures"]].to_numpy().ravel().tolist()
    assert len(files) + len(rest) == len(paths)
    bare = spark.createDataFrame([("/x/data/nominal.csv",), ("/x/data/failures.csv",)], "path string")
    assert catalog.pair_files(bare, "/x/data").first()["name"] == "OP"
    assert catalog.pair_files(bare.replace("/x/data/", "/x/data/"), "/x").first()["name"] == "data"


def test_csv_typing_and_counts(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w") as fh:
        fh.write("a,b,c,d\n1.0,1,x,1d\ninf,2,NA,2\n3,N/A,y,3\n-4,5,z,4\n")
    t = read_runs(spark, path)
    assert dict(t.df.dtypes) == {"a": "double", "b": "double", "c": "string", "d": "string"}
    assert (t.info["rows_read"], t.info["rows_dropped"], t.info["rows_with_non_finite"]) == (4, 2, 2)
    assert t.df.count() == 2
    kept = read_runs(spark, path, drop_non_finite=False)
    assert kept.info["rows_dropped"] == 0 and kept.info["rows_with_non_finite"] == 2
    assert kept.df.count() == 4 and kept.df.where("a is null").count() == 1
    assert read_failures(spark, path).count() == 2


def test_fixed_layout(spark, tmp_path):
    pdf = pd.DataFrame(np.random.RandomState(0).normal(size=(5, 26)), columns=SENSOR_NAMES)
    pdf.iloc[0, 3], pdf["other"] = np.inf, 1.0
    put(str(tmp_path / "n.csv"), pdf)
    got = read_nominal(spark, str(tmp_path / "n.csv"))
    assert got.columns == list(SENSOR_NAMES) and got.count() == 4


@pytest.fixture(scope="module")
def ds(spark, folder):
    return Dataset.from_folder(spark, folder)


def test_dataset_access(ds, folder, spark):
    assert len(ds) == 2 and ds.operating_points == ["OP_60", "OP_80"]
    op = ds["OP_60"]
    assert op.classes() == ["K1", "K2"] and op.class_counts().agg(F.sum("n")).first()[0] == 240
    assert op.X_nominal().columns == op.sensors and op.X_failures(["K1"]).count() == 120
    assert op.intensity_values().where("intensity is null").count() == 0
    assert op.describe_intensity().where("mode_guess = 'percent'").count() == 2
    assert op.quality().summary.first().n_rows == 300
    assert ds.load_info["OP_60"]["nominal"]["rows_read"] == 300
    with pytest.raises(KeyError):
        ds["nope"]
    summary = {r.op: (r.nominal, r.failures, r.classes, r.sensors) for r in ds.summary().collect()}
    assert summary["OP_80"] == (300, 240, 2, 6)
    assert ds.sensor_availability().where("OP_60 and OP_80").count() == 6
    m = catalog_runs(spark, folder)
    m["columns"]["intensity"], m["columns"]["sensors"] = "none", ["t03", "t01"]
    other = Dataset.from_manifest(spark, m)
    assert not other.has_intensity and other["OP_80"].sensors == ["t03", "t01"]


def test_quicklook_and_detection_report(ds, spark, tmp_path):
    look = quicklook(spark, ds["OP_60"], str(tmp_path / "look"))
    assert {"roles", "quality", "correlation", "spectrum", "histograms", "pca", "trends",
            "class_counts", "intensity"} <= set(look.tables)
    assert os.path.isdir(tmp_path / "look" / "quality" / "op=OP_60")
    bank = ModelBank.fit(ds, Mahalanobis(threshold="chi2", alpha=0.01))
    report, recalibrated = detection_report(
        bank, ds, str(tmp_path / "report"), at_alpha=0.05, n_boot=0, classes=["K1"])
    back = spark.read.parquet(str(tmp_path / "report" / "pod"))
    assert back.count() == 2 and {r[0] for r in back.select("alpha").distinct().collect()} == {0.05}
    assert {"rates", "thresholds", "scores", "pod_bins", "pod_curve", "score_vs_intensity",
            "sensitivity", "contribution_shares"} <= set(report.tables)
    assert recalibrated.models.table.where("alpha <> 0.05").isEmpty()
    assert bank.models.table.where("rule <> 'chi2'").isEmpty()


def test_bank_save_put_and_report_without_intensity(ds, spark, tmp_path):
    bank = ModelBank.fit(ds, Mahalanobis(threshold="chi2", alpha=0.01))
    back = ModelBank.load(spark, bank.save(str(tmp_path / "bank")))
    total = lambda b: b.score_dataset(ds).agg(F.sum("score")).first()[0]
    assert total(back) == pytest.approx(total(bank), rel=1e-12)
    swapped = bank.put("OP_80", bank["OP_60"])
    assert len(swapped) == 2
    a, b = (swapped.models.table.where(F.col("op") == o).first().threshold for o in ("OP_60", "OP_80"))
    assert a == b
    for roles in ds.roles.values():
        roles.intensity, kept = None, roles.intensity
    try:
        report, _ = detection_report(bank, ds, n_boot=0)
        assert "pod" not in report.tables and any("POD skipped" in n for n in report.notes)
    finally:
        for roles in ds.roles.values():
            roles.intensity = kept


def test_bare_table_is_all_nominal(spark):
    o = make_op(50, p=3, n_nominal=200, redundant=False)
    look = quicklook(spark, spark.createDataFrame(o.nominal))
    assert look.tables["summary"].first().failures == 0 and "pca" not in look.tables


def test_stream_scores_like_the_batch(ds, spark, tmp_path):
    src = str(tmp_path / "in")
    ds.runs.repartition(3).write.parquet(src)
    m = Mahalanobis(threshold="chi2").fit(ds["OP_60"].nominal, ds["OP_60"].sensors)
    stream = spark.readStream.schema(ds.runs.schema).parquet(src)
    q = score_stream(stream, m, str(tmp_path / "out"), str(tmp_path / "ck"),
                     ["run_id", "op", "score", "flagged"])
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = m.predict(ds.runs).select("run_id", "op", "score", "flagged")
    assert got.count() == want.count() == 540 and got.exceptAll(want).isEmpty()
