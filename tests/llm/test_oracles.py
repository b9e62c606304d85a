"""The registered queries next to their SQL by brute force."""

import glob

import pytest

from checks.compare import database, difference
from runwatch.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert difference(got, database(SF).execute(queries.ORACLE_SQL[name]).df()) is None
