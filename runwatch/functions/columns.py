"""Column expressions shared by every operator (all JVM side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import col

NOMINAL = "nominal"
FAILURE = "failure"

_INF = float("inf")


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL; Spark orders NaN above infinity."""
    return F.when(F.abs(c) < F.lit(_INF), c)


def parsed(text: Column) -> Column:
    """The number a text stands for; Java's trailing type letters are no numbers here."""
    bare = F.trim(text)
    return F.when(~bare.rlike(r"[0-9.][dDfF]$"), bare.try_cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a double; text that is no number becomes NULL."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return parsed(col(name))
    return col(name).cast("double")


def is_missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def is_non_finite(c: Column) -> Column:
    return finite(c).isNull()


def flag(score: Column, threshold: Column) -> Column:
    """``score > threshold``, false when either is NULL or NaN."""
    return F.coalesce(
        (score > threshold) & ~F.isnan(score) & ~F.isnan(threshold), F.lit(False)
    )


def with_count(df: DataFrame, name: str, bounds: str, value: str, most: int) -> DataFrame:
    """Adds ``name``: how many entries of the ascending array ``bounds`` (at most ``most``) are at or below ``value``.

    Found by halving in generated code; a function over the entries would be interpreted for every row.
    """
    out, step = df.withColumn(name, F.lit(0)), 1 << max(most, 1).bit_length() - 1
    while step:
        passed = F.get(bounds, F.col(name) + F.lit(step - 1)) <= F.col(value)
        out, step = out.withColumn(name, F.col(name) + F.when(passed, step).otherwise(0)), step // 2
    return out


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(c, F.lit(hi)), F.lit(lo))


def sigmoid(eta: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(eta, -35.0, 35.0)))


def hash_order(run_id: Column, seed: object) -> Column:
    """A random-looking but repeatable order key for one run."""
    return F.md5(F.concat(run_id.cast("string"), F.lit(f"#{seed}")))


def hash_uniform(key: Column, tag: str) -> Column:
    """Uniform number in (0, 1) from 52 bits of a keyed digest."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"#{tag}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def array_of(columns: list[Column], kind: str = "double") -> Column:
    return F.array(*columns) if columns else F.array().cast(f"array<{kind}>")
