"""Row-wise Mahalanobis algebra against a table of models.

A weight table has one row per (group, chain) with, over a common sensor axis of
length p: ``use ARRAY<BOOLEAN>``, ``shift ARRAY<DOUBLE>`` and the row-major
``weight ARRAY<DOUBLE>`` (p*p) with d^2 = |weight (x - shift)|^2.  Few sensors
are scored by generated JVM code behind a broadcast join; many by one matrix
product per Arrow batch.  No row moves while the models are few; beyond
``MODEL_BYTES`` runs and models meet block by block (``blocks``), and what moves
is spread over salts.  All ways read the runs once and accept streams.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import finite, number
from ..runtime import attach
from .blocks import Pairs, doubles, matrix, meet, repeated
from .gram import JVM_SENSORS

#: most bytes of model weights that every task holds whole
MODEL_BYTES = 32 * 1024 * 1024


def _flat_models(weights: DataFrame, keys: list[str], carry: list[str], p: int) -> DataFrame:
    """The small side with one non-null scalar column per coefficient, so that the
    generated row code reads plain doubles instead of bounds-checked array cells."""
    cell = lambda name, i, empty: F.coalesce(F.get(name, F.lit(i)), F.lit(empty))
    return weights.select(
        *keys, *carry,
        *[cell("use", j, False).alias(f"_u{j}") for j in range(p)],
        *[cell("shift", j, 0.0).alias(f"_m{j}") for j in range(p)],
        *[cell("weight", i, 0.0).alias(f"_w{i}") for i in range(p * p)],
    )


def distances(
    df: DataFrame, weights: DataFrame, axis: list[str], carry: list[str],
    keys: list[str] = ["op"], contributions: bool = False, triangular: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """``df`` joined with the models of its group: adds ``carry`` and ``d2``.

    With ``contributions`` also ``parts ARRAY<DOUBLE>`` over the axis, whose sum
    is d2.  Rows with a missing used sensor get NULL; groups without a model are
    left out.  ``triangular`` says that every weight matrix is lower triangular.
    """
    if len(axis) <= (JVM_SENSORS if triangular else JVM_SENSORS - 2):
        return _builtin(df, weights, axis, carry, keys, contributions, triangular, rows)
    return _arrow(df, weights, axis, carry, keys, contributions, rows)


def _builtin(df, weights, axis, carry, keys, contributions, triangular, n_models) -> DataFrame:
    p = len(axis)
    table = _flat_models(weights, keys, carry, p)
    joined = attach(df, table, keys, row_bytes=8 * p * (p + 2) + 256, rows=n_models)
    use = [F.col(f"_u{j}") for j in range(p)]
    x = [finite(number(joined, s)) for s in axis]
    whole = reduce(and_, [~u | v.isNotNull() for u, v in zip(use, x)])
    rows = joined.withColumns({"_ok": whole, **{
        f"_d{j}": F.coalesce(F.when(use[j], x[j] - F.col(f"_m{j}")), F.lit(0.0))
        for j in range(p)
    }})
    d = [F.col(f"_d{j}") for j in range(p)]
    y = [F.col(f"_y{k}") for k in range(p)]
    w = lambda k, j: F.col(f"_w{k * p + j}")
    filled = lambda k, j: not triangular or j <= k
    rows = rows.withColumns({
        f"_y{k}": reduce(add, [w(k, j) * d[j] for j in range(p) if filled(k, j)])
        for k in range(p)
    })
    made = {"d2": F.when(F.col("_ok"), reduce(add, [v * v for v in y]))}
    if contributions:
        parts = [
            d[j] * reduce(add, [w(k, j) * y[k] for k in range(p) if filled(k, j)])
            for j in range(p)
        ]
        made["parts"] = F.when(F.col("_ok"), F.array(*parts))
    # as the one row of an array: a later filter on the score would else be rewritten in terms of
    # the sensors and move below the steps above, which it then repeats many times over for each run
    row = F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()])))
    return rows.select(*df.columns, *carry, row)


def _arrow(df, weights, axis, carry, keys, contributions, rows) -> DataFrame:
    """One scan whatever the number of models: each meets its runs in Arrow, never in the driver's hands
    while they are many."""
    p = len(axis)
    made = [T.StructField("d2", T.DoubleType())]
    if contributions:
        made.append(T.StructField("parts", T.ArrayType(T.DoubleType())))
    out = T.StructType([*df.schema.fields, *[weights.schema[c] for c in carry], *made])
    # text and other odd types are read as numbers by the JVM, the rest in the batch itself
    odd = {s: f"_x{j}" for j, s in enumerate(axis) if not isinstance(df.schema[s].dataType, T.NumericType)}
    ready = df.withColumns({x: number(df, s) for s, x in odd.items()}) if odd else df
    facts = weights.select(*keys, *carry, "use", "shift", "weight")
    work = _scorer(df.columns, [odd.get(s, s) for s in axis], carry, contributions, to_arrow_schema(out))
    return meet(ready, facts, keys, work, out, 8 * p * (p + 2) + 256, rows, MODEL_BYTES)


def _scorer(columns: list[str], axis: list[str], carry: list[str], contributions: bool, out: pa.Schema):
    p = len(axis)
    kinds = {c: out.field(len(columns) + k).type for k, c in enumerate(carry)}

    def work(pairs: Pairs) -> Iterator[pa.RecordBatch]:
        for _, models, batch in pairs:
            x = matrix(batch, axis)
            base = [batch.column(i) for i in range(len(columns))]
            for model in models:
                weight = model["weight"].reshape(p, p)
                delta = np.where(model["use"], x - model["shift"], 0.0)
                y = delta @ weight.T
                d2 = np.einsum("ij,ij->i", y, y)
                made = [repeated(model[c], kinds[c], len(d2)) for c in carry] + [doubles(d2)]
                if contributions:
                    cells = pa.array((delta * (y @ weight)).ravel())
                    ends = pa.array(np.arange(len(d2) + 1, dtype=np.int32) * p)
                    made.append(pa.ListArray.from_arrays(ends, cells, mask=pa.array(np.isnan(d2))))
                yield pa.RecordBatch.from_arrays([*base, *made], schema=out)

    return work
