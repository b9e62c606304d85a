"""Element-wise sums of long vectors, with chunks, branches and hand-overs forced."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runwatch.operators import sums


def vectors():
    """Group g gets vectors of g + 3 cells: the row number times 1, 2, 3, ... (a local function travels by value)."""
    def run(batch):
        for g, v in zip(batch.column("g").to_pylist(), batch.column("v").to_pylist()):
            yield (g,), v * np.arange(1.0, 4 + (g or 0))

    return run


@pytest.mark.parametrize("chunk, held", [(4096, 1 << 26), (2, 0), (1, 100)])
def test_sums_equal_plain_sums(spark, monkeypatch, chunk, held):
    monkeypatch.setattr(sums, "CHUNK", chunk)
    monkeypatch.setattr(sums, "HELD_BYTES", held)
    df = spark.range(0, 1000, 1, 40).select(
        F.when(F.col("id") % 7 < 5, F.lit(1)).otherwise(F.when(F.col("id") % 7 == 5, 30)).cast("int").alias("g"),
        F.col("id").cast("double").alias("v"))
    got = {r["g"]: r["acc"] for r in sums.summed(sums.partial_vectors(df, ["g"], vectors()), ["g"]).collect()}
    want = {1: sum(i for i in range(1000) if i % 7 < 5), 30: sum(range(5, 1000, 7)), None: sum(range(6, 1000, 7))}
    assert {g: len(v) for g, v in got.items()} == {1: 4, 30: 33, None: 3}
    for g, total in want.items():
        assert got[g] == [total * k for k in range(1, len(got[g]) + 1)]


def test_rows_moved_do_not_grow_with_the_cells(spark):
    df = spark.range(0, 64, 1, 4).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("v"))

    def wide(batch):
        yield (1,), np.ones(20_000) * sum(batch.column("v").to_pylist())

    parts = sums.partial_vectors(df, ["g"], wide)
    assert parts.count() == 4 * 5
    assert sums.summed(parts, ["g"]).select(F.array_distinct("acc").alias("a")).first()["a"] == [2016.0]


def test_nothing_gives_nothing(spark):
    df = spark.createDataFrame([], "g int, v double")
    assert sums.summed(sums.partial_vectors(df, ["g"], vectors()), ["g"]).count() == 0
