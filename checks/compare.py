"""Run queries next to their SQL twins and compare whole results exactly.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)]
    out = pdf.astype(object).where(pdf.notna(), None)
    key = out.apply(lambda row: repr([str(v) for v in row]), axis=1) if len(out) else None
    return out if key is None else out.loc[key.sort_values(kind="stable").index].reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = _sorted(got), _sorted(want)
    for c in a.columns:
        bad = [i for i, (x, y) in enumerate(zip(a[c], b[c])) if x != y and not (x is None and y is None)]
        if bad:
            i = bad[0]
            return f"{c}: {len(bad)} of {len(a)} differ, first {a.iloc[i].to_dict()} != {b.iloc[i].to_dict()}"
    return None


def main() -> None:
    sys.path.insert(0, os.getcwd())
    from checks.queries import REGISTRY

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf_dir)
    for name in names:
        fn, sql = REGISTRY[name]
        t = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - t
            if sql is None:
                verdict = f"rows only: {len(got)}"
            else:
                found = difference(got, con.execute(sql).df())
                verdict = f"ok {len(got)}" if found is None else f"DIFF {found}"
        except Exception as exc:  # keep going: this is a report
            took, verdict = time.time() - t, f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        print(f"{name:28s} {took:6.1f}s {verdict}", flush=True)


if __name__ == "__main__":
    main()
