"""Moments and Gram sums per group: the one reduction every covariance needs.

The result is a packed vector per group, ``[n, sum z, upper triangle of sum z z',
sum |z|^4]``.  Few sensors are summed by built-in aggregates inside generated
code; many sensors are standardised and multiplied batch by batch in Arrow, each
task making one vector per group, and the vectors are added in a tree of whole
chunks (``sums``).  Rows are not shuffled, unless their scalings are too many to
send to every task (``blocks``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add, and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import array_of, finite, number
from ..runtime import attach, col
from .blocks import Pairs, by_group, doubles, matrix, meet
from .sums import Partials, key_fields, partial_vectors, summed, vector_schema

#: up to this many sensors the products are built-in sums in generated code
JVM_SENSORS = 8
#: the same where quartic sums are wanted too
JVM_QUARTIC = 7


def clean(df: DataFrame, sensors: list[str], keep: list[str]) -> DataFrame:
    """``keep`` plus the sensors as doubles with NaN and infinities as NULL."""
    return df.select(*keep, *[finite(number(df, s)).alias(s) for s in sensors])


def moments(df: DataFrame, keys: list[str], sensors: list[str]) -> DataFrame:
    """One scan, expressions linear in p: ``keys, n, cnt, mean, std, lo, hi`` (arrays)."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    for j, s in enumerate(sensors):
        c = col(s)
        aggs += [
            F.count(c).alias(f"_n{j}"), F.avg(c).alias(f"_m{j}"), F.stddev_pop(c).alias(f"_s{j}"),
            F.min(c).alias(f"_a{j}"), F.max(c).alias(f"_b{j}"),
        ]
    p = range(len(sensors))
    return df.groupBy(*keys).agg(*aggs).select(
        *keys, "n",
        array_of([F.col(f"_n{j}") for j in p], "bigint").alias("cnt"),
        array_of([F.col(f"_m{j}") for j in p]).alias("mean"),
        array_of([F.col(f"_s{j}") for j in p]).alias("std"),
        array_of([F.col(f"_a{j}") for j in p]).alias("lo"),
        array_of([F.col(f"_b{j}") for j in p]).alias("hi"),
    )


def standard_columns(
    df: DataFrame, stats: DataFrame, keys: list[str], sensors: list[str], use: str = "use",
    keep: list[str] | None = None, rows: int | None = None,
) -> DataFrame:
    """Attach ``center, scale, use`` arrays and return ``keep`` plus z columns.

    A sensor outside the group's ``use`` mask becomes 0, so that it adds nothing.  Many sensors
    are standardised in Arrow, where the arrays meet a whole batch instead of every row.
    """
    keep = keys if keep is None else keep
    p = len(sensors)
    facts = stats.select(*keys, "center", "scale", F.col(use).alias("_use"))
    if p > JVM_SENSORS:
        narrow = df.select(*dict.fromkeys([*keys, *keep]), *[col(s) for s in sensors])
        fields = [df.schema[k] for k in keep] + [
            T.StructField(f"z{j}", T.DoubleType()) for j in range(p)]

        def work(pairs: Pairs) -> Iterator[pa.RecordBatch]:
            for _, (fact,), batch in pairs:
                z = standardised(matrix(batch, sensors), fact)
                at = [batch.column(batch.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays(
                    [*at, *[doubles(z[:, j]) for j in range(p)]], [f.name for f in fields])

        return meet(narrow, facts, keys, work, T.StructType(fields), 24 * p + 64, rows)
    joined = attach(df, facts, keys, row_bytes=24 * p + 64, rows=rows)
    z = [
        F.when(F.col("_use")[j], (col(s) - F.col("center")[j]) / F.col("scale")[j])
        .otherwise(F.lit(0.0)).alias(f"z{j}")
        for j, s in enumerate(sensors)
    ]
    return joined.select(*keep, *z)


def standardised(x: np.ndarray, fact: dict) -> np.ndarray:
    """(x - center) / scale of a batch; 0 in sensors that are not used."""
    use = fact["_use"]
    center, scale = (np.where(use, fact[c], 1.0) for c in ("center", "scale"))
    return np.where(use, (x - center) / scale, 0.0)


def standard_gram(
    df: DataFrame, stats: DataFrame, keys: list[str], sensors: list[str], quartic: bool = False,
    by: list[str] = [], rows: int | None = None,
) -> DataFrame:
    """``gram`` of the standardised sensors, per ``keys`` and ``by`` (columns of the rows).

    With many sensors a batch is standardised and summed in one Arrow function.
    """
    group, p = [*keys, *by], len(sensors)
    if not _wide(p, quartic):
        z = standard_columns(df, stats, keys, sensors, keep=group, rows=rows)
        return gram(z, group, [f"z{j}" for j in range(p)], quartic)
    narrow = df.select(*group, *[col(s) for s in sensors])
    facts = stats.select(*keys, "center", "scale", F.col("use").alias("_use"))
    fields = key_fields(narrow, group)

    def work(pairs: Pairs) -> Iterator[pa.RecordBatch]:
        held = Partials(fields)
        for _, (fact,), batch in pairs:
            for key, part in by_group(batch, group):
                z = standardised(matrix(part, sensors), fact)
                held.add(key, pack(z[~np.isnan(z).any(axis=1)], quartic))
            if held.full():
                yield from held.batches()
        yield from held.batches()

    return summed(meet(narrow, facts, keys, work, vector_schema(narrow, group), 24 * p + 64, rows), group)


def packed_size(p: int, quartic: bool = False) -> int:
    half = p * (p + 1) // 2
    return 1 + p + half + (half + p * p if quartic else 1)


def gram(
    df: DataFrame, keys: list[str], columns: list[str], quartic: bool = False
) -> DataFrame:
    """Packed sums over the rows complete in ``columns``: ``keys, acc ARRAY<DOUBLE>``.

    With ``quartic`` the last number gives way to the sums of z_i^2 z_j^2 (upper
    triangle) and z_i^2 z_j (all pairs): enough to have sum |z|^4 of any subset
    of the columns after any shift and scaling, without another scan.
    """
    whole = reduce(and_, [F.col(c).isNotNull() for c in columns])
    rows = df.where(whole)
    if not _wide(len(columns), quartic):
        return _gram_builtin(rows, keys, columns, quartic)

    def vectors(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
        for key, part in by_group(batch, keys):
            yield key, pack(matrix(part, columns), quartic)

    return summed(partial_vectors(rows.select(*keys, *columns), keys, vectors), keys)


def _wide(p: int, quartic: bool) -> bool:
    return p > (JVM_QUARTIC if quartic else JVM_SENSORS)


def _gram_builtin(rows: DataFrame, keys: list[str], columns: list[str], quartic: bool) -> DataFrame:
    solid = rows.select(*keys, *[F.coalesce(x, F.lit(0.0)).alias(x) for x in columns])
    c = [F.col(x) for x in columns]
    p = len(c)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    parts = [F.count(F.lit(1)).cast("double")]
    parts += [F.sum(x) for x in c]
    parts += [F.sum(c[i] * c[j]) for i, j in pairs]
    if quartic:
        parts += [F.sum(c[i] * c[i] * c[j] * c[j]) for i, j in pairs]
        parts += [F.sum(c[i] * c[i] * c[j]) for i in range(p) for j in range(p)]
    else:
        square = reduce(add, [x * x for x in c])
        parts.append(F.sum(square * square))
    names = [f"_p{i}" for i in range(len(parts))]
    wide = solid.groupBy(*keys).agg(*[x.alias(n) for x, n in zip(parts, names)])
    return wide.select(*keys, F.array(*names).alias("acc"))


def pack(z: np.ndarray, quartic: bool) -> np.ndarray:
    """The packed vector of one block of complete rows."""
    upper = np.triu_indices(z.shape[1])
    head = [[len(z)], z.sum(axis=0), (z.T @ z)[upper]]
    squares = z * z
    if quartic:
        return np.concatenate([*head, (squares.T @ squares)[upper], (squares.T @ z).ravel()])
    total = squares.sum(axis=1)
    return np.concatenate([*head, [np.dot(total, total)]])


def _square(values: np.ndarray, p: int) -> np.ndarray:
    full = np.zeros((p, p))
    full[np.triu_indices(p)] = values
    return full + np.triu(full, 1).T


def unpack(acc: np.ndarray, p: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """``n, sum z, sum z z' (full)`` and the fourth-order rest of a packed vector."""
    acc = np.asarray(acc, dtype=float)
    end = 1 + p + p * (p + 1) // 2
    return int(round(acc[0])), acc[1:1 + p], _square(acc[1 + p:end], p), acc[end:]


def fourth_power(
    acc: np.ndarray, p: int, pick: np.ndarray, shift: np.ndarray, scale: np.ndarray
) -> float:
    """sum |(z - shift) / scale|^4 over the columns ``pick``, from quartic sums."""
    n, total, cross, rest = unpack(acc, p)
    half = p * (p + 1) // 2
    at = np.ix_(pick, pick)
    q, c = _square(rest[:half], p)[at], rest[half:].reshape(p, p)[at]
    t, g, m = total[pick], cross[at], shift
    s = np.diag(g)
    mm = np.outer(m, m)
    moved = (
        q - 2.0 * c * m[None, :] - 2.0 * c.T * m[:, None]
        + np.outer(s, m * m) + np.outer(m * m, s) + 4.0 * mm * g
        - 2.0 * np.outer(m * t, m * m) - 2.0 * np.outer(m * m, m * t) + n * mm * mm
    )
    a = 1.0 / (scale * scale)
    return float(a @ moved @ a)


def correlation(acc: np.ndarray | None, p: int) -> np.ndarray:
    """Population correlation; a column without spread has 1 on the diagonal only."""
    if acc is None:
        return np.zeros((p, p))
    n, total, cross, _ = unpack(acc, p)
    shift = total / n
    cov = cross / n - np.outer(shift, shift)
    var = np.diag(cov)
    flat = var <= 1e-22
    root = np.sqrt(np.where(flat, 1.0, var))
    r = cov / np.outer(root, root)
    r[flat, :] = 0.0
    r[:, flat] = 0.0
    np.fill_diagonal(r, 1.0)
    return r


def per_row(
    df: DataFrame, fn: Callable[[dict], dict | list[dict]], schema: str
) -> DataFrame:
    """Apply a small function to each row of a reduced table (one row per group)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[dict] = []
            for row in pdf.to_dict("records"):
                made = fn(row)
                out.extend(made if isinstance(made, list) else [made])
            if out:
                yield pd.DataFrame(out)

    return df.mapInPandas(run, schema)
