"""The registered queries against DuckDB on the smallest tables."""

import glob

import pytest

import __spark_entry__ as entry
from checks.compare import database, difference

SF = "/root/testdata/sf0.001"
FAST = [
    "class_counts", "dataset_summary", "missing_counts", "duplicate_rows", "standardize",
    "add_noise", "split", "catalog_pairs", "label_candidates", "sensor_sensitivity",
    "score_dataset", "contributions", "alpha_tradeoff",
]


def test_names_line_up():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 60


@pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="no test tables here")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql_twin(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = database(SF).execute(entry.oracle_sql()[name]).df()
    assert difference(got, want) is None


@pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="no test tables here")
def test_entry_runs(spark):
    assert entry.entry(spark).count() == 2
