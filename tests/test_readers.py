"""Cases of the readers, the catalog and the quantiles that once went wrong."""

import os

import pytest
from pyspark.sql import functions as F

from runwatch import Dataset
from runwatch.functions.columns import number
from runwatch.operators import quantiles
from runwatch.operators.quality import implied
from runwatch.sources import catalog, tables

import numpy as np


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)


def test_type_letters_are_no_numbers(spark):
    rows = spark.createDataFrame([("5d",), ("1f",), (" 2.5 ",), ("1e3",), ("inf",), ("x",), (None,)], "t string")
    got = [r[0] for r in rows.select(number(rows, "t")).collect()]
    assert got == [None, None, 2.5, 1000.0, float("inf"), None, None]


def test_quoted_line_breaks_stay_in_their_cell(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    write(path, 'Failure,s\n"one\ntwo",1\nplain,2\nplain,3\nplain,4\n')
    got = tables.read_runs(spark, path)
    assert got.info["rows_read"] == 4
    assert {r.Failure for r in got.df.collect()} == {"one\ntwo", "plain"}


def test_labels_keep_their_white_space(spark, tmp_path):
    path = str(tmp_path / "b.csv")
    write(path, 'Failure,s\n" A", 1\nA,2 \n')
    rows = tables.typed_csv(spark, path).collect()
    assert {r.Failure for r in rows} <= {" A", "A"} and [r.s for r in rows] == [1.0, 2.0]


def test_colliding_names_take_the_next_free_number(spark, tmp_path):
    root = str(tmp_path / "lake")
    for folder in ("a/b", "a_b", "a_b_2"):
        for side in ("nominal", "failures"):
            write(f"{root}/{folder}/{side}.csv", "s\n1\n")
    ops = catalog.catalog_runs(spark, root)["operating_points"]
    assert list(ops) == ["a_b", "a_b_2", "a_b_2_2"]
    assert ops["a_b_2_2"]["nominal"] == "a_b_2/nominal.csv"


def test_files_spark_passes_over_are_read(spark, tmp_path):
    root = str(tmp_path / "lake")
    for name in ("_OP1_nominal", "_OP1_failures", "OP2_nominal", "OP2_failures", ".x_nominal", ".old/_a/_nominal", ".old/_a/failures"):
        rows = "".join(f"{i},{i % 7}.5,{'K' if i % 2 else 'L'}\n" for i in range(20))
        write(f"{root}/{name}.csv", "s,t,Failure\n" + rows)
    got = catalog.catalog_runs(spark, root)
    assert list(got["operating_points"]) == [".old__a", "OP1", "OP2"] or set(got["operating_points"]) == {"OP1", "OP2", ".old__a"}
    assert got["unmatched"] == [".x_nominal.csv"] and got["operating_points"]["OP1"]["nominal"] == "_OP1_nominal.csv"
    ds = Dataset.from_manifest(spark, got)
    counts = {(r["op"], r["set"]): r["count"] for r in ds.runs.groupBy("op", "set").count().collect()}
    assert counts == {(op, side): 20 for op in got["operating_points"] for side in ("nominal", "failure")}
    assert ds.load_info["OP1"]["nominal"]["rows_read"] == 20


def test_narrowing_ends_at_the_ends_of_the_doubles(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FINISH_ROWS", 10)
    values = [-1e308 + 1e305 * k for k in range(1000)] + [1e308 - 1e305 * k for k in range(1000)]
    rows = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = quantiles.grouped_quantiles(rows, ["g"], "v", [0.25, 0.5], exact_rows=100).first()["q"]
    assert got[0] == pytest.approx(np.quantile(values, 0.25))
    low, high = sorted(values)[999:1001]
    assert low <= got[1] <= high


def test_an_implied_sensor_implies_no_other():
    linked = np.zeros((5, 5), bool)
    linked[0, 1] = linked[1, 2] = linked[2, 3] = linked[3, 4] = True
    assert implied(linked, np.zeros(5, bool)).tolist() == [False, True, False, True, False]
    assert implied(linked, np.array([True, False, False, False, False])).tolist() == [True, False, True, False, True]


def test_recalibration_leaves_other_models_alone(spark):
    from conftest import make_op, with_ids
    from runwatch import Mahalanobis, ModelBank, Dataset

    parts = []
    for name, seed in (("A", 1), ("B", 2)):
        part = with_ids(make_op(seed, p=3, n_nominal=400, classes=1, per_class=5, redundant=False).nominal, name)
        parts.append(spark.createDataFrame(part))
    runs = parts[0].unionByName(parts[1]).withColumns({
        "set": F.lit("nominal"), "class": F.lit(None).cast("string"), "intensity": F.lit(None).cast("double")})
    ds = Dataset.from_runs(runs, ["t00", "t01", "t02"], has_label=False, has_intensity=False)
    bank = ModelBank.fit(ds, Mahalanobis(alpha=0.01))
    again = bank.recalibrated(runs.where("op = 'A'"), 0.1)
    old = {r.op: r.threshold for r in bank.models.table.select("op", "threshold").collect()}
    new = {r.op: r.threshold for r in again.models.table.select("op", "threshold").collect()}
    assert new["B"] == old["B"] and new["A"] < old["A"]


def test_a_frame_without_op_is_scored_by_name(spark):
    from conftest import make_op
    from runwatch import Dataset, Mahalanobis, ModelBank

    nominal = spark.createDataFrame(make_op(1, p=3, n_nominal=300, classes=1, per_class=5, redundant=False).nominal)
    bank = ModelBank.fit(Dataset.from_frames(nominal, None, "A", label="none", intensity="none"), Mahalanobis())
    assert bank.score(nominal, "A").where("score IS NOT NULL").count() == 300
    with pytest.raises(KeyError):
        bank.predict(nominal, "B")


def test_a_failing_table_leaves_the_others(spark, tmp_path):
    from runwatch.plans.report import Report

    good = spark.range(3)
    bad = good.select(F.raise_error(F.lit("no such thing")).alias("x"))
    report = Report({"good": good, "bad": bad})
    assert [p.rsplit("/", 1)[1] for p in report.write(str(tmp_path / "out"))] == ["good"]
    assert len(report.notes) == 1 and "bad" in report.notes[0]
    with pytest.raises(Exception):
        Report({"bad": bad}).write(str(tmp_path / "none"))
