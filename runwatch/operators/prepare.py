"""Scaling, redundancy removal and synthetic noise, per operating point."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import array_of, hash_uniform
from ..runtime import attach, col, materialise
from .gram import clean, correlation, moments, per_row, standard_gram
from .quantiles import EXACT_ROWS, grouped_quantiles

#: |r| from which two sensors count as collinear (fixed value)
COLLINEAR = 0.999
#: makes the median absolute deviation estimate sigma on Gaussian data (fixed value)
MAD_TO_SIGMA = 1.4826
CONSTANT = "(constant)"


def stats_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def sound_scale(scale: Column) -> Column:
    """Per element: the scale where it is positive, else 1."""
    return F.transform(scale, lambda s: F.when(s > 0, s).otherwise(F.lit(1.0)))


def degenerate_names(scale: Column, sensors: list[str]) -> Column:
    names = F.array(*[F.lit(s) for s in sensors])
    marked = F.transform(
        scale, lambda s, i: F.when(F.coalesce(s > 0, F.lit(False)), F.lit(None)).otherwise(names[i])
    )
    return F.array_compact(marked)


def fit_scaler(
    df: DataFrame, keys: list[str], sensors: list[str], method: str = "standard",
    exact_rows: int | None = None,
) -> DataFrame:
    """``keys, n, center, scale, degenerate``; missing values are skipped."""
    if method not in ("standard", "robust", "none"):
        raise ValueError("method must be 'standard', 'robust' or 'none'")
    rows = clean(df, sensors, keys)
    if method == "none":
        raw = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(
            *keys, "n", array_of([F.lit(0.0)] * len(sensors)).alias("center"),
            array_of([F.lit(1.0)] * len(sensors)).alias("raw"),
        )
    elif method == "standard":
        raw = moments(rows, keys, sensors).select(
            *keys, "n", F.col("mean").alias("center"), F.col("std").alias("raw")
        )
    else:
        raw = _robust(rows, keys, sensors, exact_rows)
    return raw.select(
        *keys, "n", "center", sound_scale(F.col("raw")).alias("scale"),
        degenerate_names(F.col("raw"), sensors).alias("degenerate"),
    )


def _robust(
    rows: DataFrame, keys: list[str], sensors: list[str], exact_rows: int | None
) -> DataFrame:
    sizes = materialise(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), array_of([F.count(col(s)) for s in sensors], "bigint").alias("cnt")))
    med = materialise(_medians(rows, keys, sensors, sizes, "center", exact_rows))
    joined = attach(rows, med, keys, row_bytes=8 * len(sensors) + 64)
    gaps = joined.select(
        *keys, *[F.abs(col(s) - F.col("center")[j]).alias(s) for j, s in enumerate(sensors)]
    )
    mad = _medians(gaps, keys, sensors, sizes, "mad", exact_rows)
    return sizes.join(med, keys).join(mad, keys).select(
        *keys, "n", "center",
        F.transform("mad", lambda m: m * F.lit(MAD_TO_SIGMA)).alias("raw"),
    )


def _medians(
    rows: DataFrame, keys: list[str], sensors: list[str], sizes: DataFrame, name: str,
    exact_rows: int | None,
) -> DataFrame:
    # one task holds the values of all sensors of a group
    limit = (EXACT_ROWS if exact_rows is None else exact_rows) // max(len(sensors), 1)
    if (sizes.agg(F.max("n")).first()[0] or 0) <= limit:
        wide = rows.groupBy(*keys).agg(
            *[F.median(col(s)).alias(f"_q{j}") for j, s in enumerate(sensors)]
        )
        return wide.select(
            *keys, array_of([F.col(f"_q{j}") for j in range(len(sensors))]).alias(name)
        )
    pair = [F.struct(F.lit(j).alias("j"), col(s).alias("v")) for j, s in enumerate(sensors)]
    long = rows.select(*keys, F.explode(F.array(*pair)).alias("e")).select(*keys, "e.j", "e.v")
    # values and their gaps are missing in the same rows
    counts = sizes.select(*keys, F.posexplode("cnt").alias("j", "n")).where("n > 0")
    q = grouped_quantiles(long, [*keys, "j"], "v", [0.5], counts, limit)
    filled = F.map_from_entries(F.collect_list(F.struct("j", F.col("q")[0].alias("x"))))
    return q.groupBy(*keys).agg(filled.alias("m")).select(
        *keys, array_of([F.col("m")[j] for j in range(len(sensors))]).alias(name)
    )


def scale(
    df: DataFrame, scaler: DataFrame, keys: list[str], sensors: list[str]
) -> DataFrame:
    """(x - center) / scale in place, matched by sensor name; works on streams."""
    return _affine(df, scaler, keys, sensors, lambda x, c, s: (x - c) / s)


def unscale(
    df: DataFrame, scaler: DataFrame, keys: list[str], sensors: list[str]
) -> DataFrame:
    return _affine(df, scaler, keys, sensors, lambda z, c, s: z * s + c)


def _affine(df, scaler, keys, sensors, fn) -> DataFrame:
    joined = attach(
        df, scaler.select(*keys, F.col("center").alias("_c"), F.col("scale").alias("_s")),
        keys, row_bytes=16 * len(sensors) + 64,
    )
    moved = {
        s: fn(col(s).cast("double"), F.col("_c")[j], F.col("_s")[j])
        for j, s in enumerate(sensors)
    }
    return joined.withColumns(moved).drop("_c", "_s")


def scaler_table(scaler: DataFrame, keys: list[str], sensors: list[str]) -> DataFrame:
    """Long form: ``keys, sensor, position, center, scale``."""
    return scaler.select(*keys, F.posexplode(
        F.arrays_zip(F.array(*[F.lit(s) for s in sensors]).alias("sensor"), "center", "scale")
    ).alias("position", "e")).select(*keys, "e.sensor", "position", "e.center", "e.scale")


def live_stats(rows: DataFrame, keys: list[str], sensors: list[str]) -> DataFrame:
    """Moments plus ``center``, ``scale`` and the mask of sensors with any spread."""
    return moments(rows, keys, sensors).select(
        "*", F.col("mean").alias("center"), sound_scale(F.col("std")).alias("scale"),
        F.transform(
            F.arrays_zip("lo", "hi"), lambda e: F.coalesce(e["lo"] < e["hi"], F.lit(False))
        ).alias("use"),
    )


def correlation_sums(
    rows: DataFrame, stats: DataFrame, keys: list[str], sensors: list[str]
) -> DataFrame:
    """Stats joined with the packed Gram of the rows complete in the live sensors."""
    return stats.join(standard_gram(rows, stats, keys, sensors), keys, "left")


def drop_redundant(
    df: DataFrame, keys: list[str], sensors: list[str], threshold: float = COLLINEAR,
    protect: list[str] | None = None, stats: DataFrame | None = None,
) -> DataFrame:
    """Per group a non-redundant sensor list: ``keys, kept, dropped, use``.

    ``dropped`` maps a removed sensor to the first kept one it repeats, or to
    ``(constant)``; ``use`` is the kept mask in the order of ``sensors``.
    """
    rows = clean(df, sensors, keys)
    if stats is None:
        stats = materialise(live_stats(rows, keys, sensors))
    table = correlation_sums(rows, stats, keys, sensors)
    safe, names, p = set(protect or []), list(sensors), len(sensors)

    def choose(row: dict) -> dict:
        live = np.asarray(row["use"], dtype=bool)
        kept, dropped = first_of_each(
            np.abs(correlation(row["acc"], p)), live, names, threshold, safe)
        use = [j in kept for j in range(p)]
        out = {k: row[k] for k in keys}
        return {**out, "kept": [names[j] for j in kept], "dropped": dropped, "use": use}

    schema = f"{stats_schema(df, keys)}, kept array<string>, dropped map<string,string>, use array<boolean>"
    return per_row(table.select(*keys, "use", "acc"), choose, schema)


def first_of_each(
    r: np.ndarray, live: np.ndarray, names: list[str], threshold: float,
    safe: set[str] | frozenset = frozenset(),
) -> tuple[list[int], dict[str, str]]:
    """First sensor of every redundant set, in column order, from |r| of one group."""
    dropped: dict[str, str] = {}
    kept: list[int] = []
    for j, name in enumerate(names):
        if not live[j] and name not in safe:
            dropped[name] = CONSTANT
            continue
        twin = next((k for k in kept if live[j] and r[j, k] >= threshold), None)
        if twin is None or name in safe:
            kept.append(j)
        else:
            dropped[name] = names[twin]
    return kept, dropped


def redundancy_table(dropped: DataFrame, keys: list[str], sensors: list[str]) -> DataFrame:
    """Long form: ``keys, sensor, kept, duplicate_of``."""
    names = F.array(*[F.lit(s) for s in sensors])
    return dropped.select("*", F.explode(names).alias("sensor")).select(
        *keys, "sensor", F.array_contains("kept", F.col("sensor")).alias("kept"),
        F.try_element_at("dropped", F.col("sensor")).alias("duplicate_of"),
    )


def add_noise(
    df: DataFrame, keys: list[str], sensors: list[str], level: float, mode: str = "sigma",
    run_id: str = "run_id", seed: object = 0, reference: DataFrame | None = None,
) -> DataFrame:
    """Gaussian measurement noise, the same for a run whatever the partitioning.

    ``sigma``: level times each sensor's own spread, or that of the scaler table
    ``reference``; ``relative``: level times |mean|; ``absolute``: level itself.
    """
    if mode not in ("sigma", "relative", "absolute"):
        raise ValueError("mode must be 'sigma', 'relative' or 'absolute'")
    if level <= 0:
        return df
    if mode == "absolute":
        joined = df
        sigma = [F.lit(float(level))] * len(sensors)
    else:
        if mode == "sigma" and reference is not None:
            spread = reference.select(*keys, F.col("scale").alias("_w"))
        else:
            stats = materialise(moments(clean(df, sensors, keys), keys, sensors))
            which = F.col("std") if mode == "sigma" else F.transform("mean", lambda m: F.abs(m))
            spread = stats.select(*keys, which.alias("_w"))
        joined = attach(df, spread, keys, row_bytes=8 * len(sensors) + 64)
        sigma = [F.coalesce(F.lit(float(level)) * F.col("_w")[j], F.lit(0.0))
                 for j in range(len(sensors))]
    moved = {}
    for j, s in enumerate(sensors):
        radius = F.sqrt(F.lit(-2.0) * F.ln(hash_uniform(F.col(run_id), f"{seed}#{s}#r")))
        angle = F.lit(2.0 * np.pi) * hash_uniform(F.col(run_id), f"{seed}#{s}#a")
        moved[s] = col(s).cast("double") + radius * F.cos(angle) * sigma[j]
    return joined.withColumns(moved).drop("_w")
