"""Projections and filters on the canonical runs table
``run_id, op, set, class, intensity, <sensors>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import FAILURE, NOMINAL, finite, number
from ..runtime import col

ALL_CLASSES = "(all)"
UNLABELLED = "(unlabelled)"


def select_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns as doubles in the given order; bad text becomes NULL."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing column(s): {missing}")
    return df.select(*[number(df, c).alias(c) for c in columns])


def nominal_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("set") == NOMINAL)


def failure_runs(runs: DataFrame, classes: list[str] | None = None) -> DataFrame:
    rows = runs.where(F.col("set") == FAILURE)
    if classes is None:
        return rows
    return rows.where(F.col("class").cast("string").isin([str(c) for c in classes]))


def signed_intensity(df: DataFrame, column: str = "intensity") -> Column:
    if column not in df.columns:
        return F.lit(None).cast("double")
    return finite(number(df, column))


def class_names(runs: DataFrame) -> DataFrame:
    """Distinct non-NULL labels as strings, in order, per operating point."""
    named = failure_runs(runs).select("op", F.col("class").cast("string").alias("class"))
    return named.dropna().distinct().orderBy("op", "class")


def class_counts(runs: DataFrame) -> DataFrame:
    named = failure_runs(runs).select(
        "op", F.coalesce(F.col("class").cast("string"), F.lit(UNLABELLED)).alias("class"))
    return named.groupBy("op", "class").agg(F.count(F.lit(1)).alias("n")).orderBy("op", "class")


def largest_intensities(runs: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` runs of largest intensity of each class: ``op, class, place, run_id, intensity``.

    Only the first ``n`` rows of a class and task are shuffled; ties go by run.
    """
    rows = failure_runs(runs).select(
        "op", F.col("class").cast("string").alias("class"), "run_id",
        F.abs(signed_intensity(runs)).alias("intensity")).where("intensity IS NOT NULL AND class IS NOT NULL")
    place = F.row_number().over(
        Window.partitionBy("op", "class").orderBy(F.col("intensity").desc(), F.col("run_id")))
    return rows.withColumn("place", place).where(F.col("place") <= n).select(
        "op", "class", "place", "run_id", "intensity")


def intensity_mode(lo: Column, hi: Column) -> Column:
    """Hint at the unit: percent (0-100 or a fraction), absolute, or unknown."""
    return (
        F.when(lo.isNull(), "unknown")
        .when((lo >= 0) & (hi >= 20) & (hi <= 100), "percent")
        .when((hi > 100) | (lo < -100), "absolute")
        .when((lo >= 0) & (hi <= 1), "percent")
        .otherwise("unknown")
    )


def describe_intensity(
    df: DataFrame, intensity: str = "intensity", label: str | None = "class",
    keys: list[str] = ["op"],
) -> DataFrame:
    """Per class: ``n, min, max, abs_max, n_unique, mode_guess``; empty classes left out."""
    name = F.lit(ALL_CLASSES) if label is None else col(label).cast("string")
    rows = df.select(*keys, name.alias("class"), signed_intensity(df, intensity).alias("_x"))
    rows = rows.where(F.col("_x").isNotNull() & F.col("class").isNotNull())
    # distinct values first: copies collapse before the shuffle
    cells = rows.groupBy(*keys, "class", "_x").agg(F.count(F.lit(1)).alias("c"))
    made = cells.groupBy(*keys, "class").agg(
        F.sum("c").alias("n"), F.min("_x").alias("min"), F.max("_x").alias("max"),
        F.max(F.abs("_x")).alias("abs_max"), F.count(F.lit(1)).alias("n_unique"),
    )
    guess = intensity_mode(F.col("min"), F.col("max"))
    return made.withColumn("mode_guess", guess).orderBy(*keys, "class")
