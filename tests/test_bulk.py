"""Many files in few scans, next to the same files read one by one."""

import os

import pytest
from pyspark.sql import functions as F

from runwatch import Dataset
from runwatch.operators.roles import infer_roles
from runwatch.sources import catalog
from runwatch.sources.dataset import _canonical
from runwatch.sources.tables import read_runs


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)


def put_op(root, name, k, head="s,t,note,Failure,Intensity", label=lambda i: "K" if i % 2 else "L"):
    full = head.split(",")
    row = lambda i: {"s": f"{i + k}.5", "t": "inf" if i == 3 else str(i % 7), "note": "" if i % 5 else f"n{i}",
                     "Failure": label(i), "Intensity": f"{-i / 10}", "level_x": str(i % 3), "u": "-0.0" if i % 2 else "0.0"}
    lines = [",".join(row(i)[c] for c in full) for i in range(40)]
    write(f"{root}/{name}/failures.csv", head + "\n" + "\n".join(lines) + "\n")
    plain = [c for c in full if c not in ("Failure", "Intensity")]
    lines = [",".join(row(i)[c] for c in plain) for i in range(30)]
    write(f"{root}/{name}/nominal.csv", ",".join(plain) + "\r\n" + "\r\n".join(lines) + "\r\n")


def content(runs, sensors):
    missing = [F.lit(None).cast("double").alias(s) for s in sensors if s not in runs.columns]
    have = [F.col(f"`{s}`") for s in sensors if s in runs.columns]
    rows = runs.select("op", "set", "class", "intensity", *have, *missing).select(
        "op", "set", "class", "intensity", *[f"`{s}`" for s in sensors]).collect()
    return sorted(map(repr, rows))


@pytest.mark.parametrize("drop", [True, False])
def test_bulk_reading_equals_reading_one_by_one(spark, tmp_path, drop):
    root = str(tmp_path / "a lake")
    put_op(root, "A", 0)
    put_op(root, "B 1", 5, label=lambda i: str(i % 4))                        # labels are numbers
    put_op(root, "C", 9, "u,s,Failure,Intensity,level_x")                      # another header
    put_op(root, "D", 2, label=lambda i: '"two\nlines"' if i == 1 else "K")   # broken lines
    put_op(root, "E", 2, "s,t,Failure,Intensity", label=lambda i: "")          # a label column without labels
    write(f"{root}/F/nominal.csv", "s,t\n")                                    # no rows
    write(f"{root}/F/failures.csv", "s,t,Failure,Intensity\n1,2,K,0.5\n2,3,L,0.7\n")
    manifest = catalog.catalog_runs(spark, root)
    assert len(manifest["operating_points"]) == 6
    ds = Dataset.from_manifest(spark, manifest, drop)
    sensors = ds.all_sensors()
    for name, files in manifest["operating_points"].items():
        tables = {side: read_runs(spark, f"{root}/{files[key]}", drop)
                  for side, key in (("nominal", "nominal"), ("failure", "failures"))}
        roles = infer_roles(tables["failure"].df, tables["nominal"].df)
        assert ds.roles[name] == roles, name
        assert ds.load_info[name] == {side: t.info for side, t in tables.items()}, name
        want = _canonical(name, tables["nominal"].df, tables["failure"].df, roles)
        assert content(ds[name].runs, sensors) == content(want, sensors), name
    assert ds.runs.select("run_id").distinct().count() == ds.runs.count()


def test_one_file_may_serve_several_operating_points(spark, tmp_path):
    root = str(tmp_path)
    put_op(root, "A", 0)
    entry = {"nominal": "A/nominal.csv", "failures": "A/failures.csv"}
    ds = Dataset.from_manifest(spark, {"root": root, "operating_points": {"x": entry, "y": entry}})
    counts = {(r["op"], r["set"]): r["count"] for r in ds.runs.groupBy("op", "set").count().collect()}
    assert counts == {(op, s): n for op in "xy" for s, n in (("nominal", 29), ("failure", 39))}
    write(f"{root}/empty.csv", "")
    with pytest.raises(ValueError, match="no header"):
        Dataset.from_manifest(spark, {"root": root, "operating_points": {
            "x": entry, "y": {**entry, "nominal": "empty.csv"}}})


def test_headers_of_several_lines_are_not_mixed_up(spark, tmp_path):
    root = str(tmp_path)
    for name, second in (("A", "one"), ("B", "two")):
        head = f's,"t\n{second}"'
        write(f"{root}/{name}/nominal.csv", head + "\n1,2\n3,4\n")
        write(f"{root}/{name}/failures.csv", head + ",Failure\n1,2,K\n3,4,L\n")
    ds = Dataset.from_folder(spark, root)
    assert {op: ds[op].sensors for op in ds.operating_points} == {"A": ["s", "t\none"], "B": ["s", "t\ntwo"]}
    assert ds.runs.where("op = 'B'").agg(F.sum("`t\ntwo`")).first()[0] == 12


def test_jobs_do_not_grow_with_the_operating_points(spark, tmp_path):
    jobs = []
    for n in (3, 24):
        root = str(tmp_path / f"lake{n}")
        for k in range(n):
            put_op(root, f"OP_{k}", k)
        manifest = catalog.catalog_runs(spark, root)
        group = f"bulk-{n}"
        spark.sparkContext.setJobGroup(group, group)
        ds = Dataset.from_manifest(spark, manifest)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext.setJobGroup("other", "other")
        assert len(ds) == n and ds.runs.count() == n * 68
    # from 33 paths on Spark lists the files of a scan in a job of its own
    assert jobs[1] <= jobs[0] + 3
