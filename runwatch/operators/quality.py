"""Data quality: missing values, constant, duplicate and collinear sensors, rank."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import array_of, is_missing, is_non_finite, number
from ..runtime import col, materialise
from .gram import clean, correlation, per_row
from .prepare import COLLINEAR, correlation_sums, live_stats, stats_schema

# fixed values: |r| limits of the three pair classes
EXACT_DUPLICATE = 1.0 - 1e-9
STRONG = 0.98
RCOND = 1e-8
MIN_SAMPLES_PER_SENSOR = 10
PAIR_KINDS = ("duplicate", "collinear", "strong")


@dataclass
class Quality:
    """``summary``: one row per group; ``sensors``: per sensor; ``pairs``: per pair."""

    summary: DataFrame
    sensors: DataFrame
    pairs: DataFrame
    keys: list[str]

    def affected(self) -> DataFrame:
        """Only sensors with a finding, in name order."""
        hit = (F.col("missing") > 0) | (F.col("non_finite") > 0) | F.col("constant")
        return self.sensors.where(hit).orderBy(*self.keys, "sensor")

    def spectrum(self) -> DataFrame:
        """Eigenvalues of the correlation matrix with the floor of the rank rule."""
        e = self.summary.where(F.size("eigenvalues") > 0)
        return e.select(
            *self.keys, "effective_rank", "condition_number",
            (F.lit(RCOND) * F.col("eigenvalues")[0]).alias("floor"),
            F.posexplode("eigenvalues").alias("at", "eigenvalue"),
        ).withColumn("component", (F.col("at") + 1).cast("bigint")).drop("at")

    def redundant(self) -> DataFrame:
        return self.summary.select(*self.keys, F.explode("redundant").alias("sensor"))


def sensor_counts(df: DataFrame, keys: list[str], sensors: list[str]) -> DataFrame:
    """``keys, sensor, position, missing, non_finite, constant``: one scan, linear in p.

    The one-row result of each group is turned into rows, not the data.
    """
    aggs = []
    for j, s in enumerate(sensors):
        c = number(df, s)
        good = F.when(~is_non_finite(c), c)
        aggs += [
            F.count_if(is_missing(c)).alias(f"_m{j}"),
            F.count_if(is_non_finite(c)).alias(f"_f{j}"),
            F.coalesce(F.min(good) >= F.max(good), F.lit(True)).alias(f"_c{j}"),
        ]
    rows = [
        F.struct(
            F.lit(s).alias("sensor"), F.lit(j).alias("position"), F.col(f"_m{j}").alias("missing"),
            F.col(f"_f{j}").alias("non_finite"), F.col(f"_c{j}").alias("constant"),
        )
        for j, s in enumerate(sensors)
    ]
    wide = df.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.inline(F.array(*rows)))


def duplicate_rows(df: DataFrame, keys: list[str], sensors: list[str]) -> DataFrame:
    """Rows equal to another over all sensors, first copies not counted.

    Copies collapse before the shuffle (partial aggregation), so one heavily
    repeated run does not load one task.
    """
    rows = df.select(*keys, *[F.nanvl(number(df, s), F.lit(None)).alias(s) for s in sensors])
    groups = rows.groupBy(*keys, *[col(s) for s in sensors]).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.groupBy(*keys).agg(F.sum(F.col("_copies") - 1).cast("bigint").alias("duplicate_rows"))


def check(
    df: DataFrame, keys: list[str], sensors: list[str] | None = None, rcond: float = RCOND,
    strong: float = STRONG,
) -> Quality:
    """All checks for every group in three aggregate jobs."""
    if sensors is None:
        kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
        numeric = [f.name for f in df.schema.fields
                   if f.dataType.simpleString() in kinds or f.dataType.typeName() == "decimal"]
        sensors = [c for c in numeric if c not in keys]
    per_sensor = materialise(sensor_counts(df, keys, sensors))
    rows = clean(df, sensors, keys)
    any_bad = F.exists(array_of([col(s) for s in sensors]), lambda x: x.isNull())
    bad_rows = rows.groupBy(*keys).agg(F.count_if(any_bad).alias("rows_non_finite"))
    stats = materialise(live_stats(rows, keys, sensors))
    table = (
        correlation_sums(rows, stats, keys, sensors).select(*keys, "n", "use", "acc")
        .join(bad_rows, keys)
        .join(duplicate_rows(df, keys, sensors), keys)
        .join(per_sensor.groupBy(*keys).agg(
            F.sum("non_finite").cast("bigint").alias("values_non_finite")), keys)
    )
    names = list(sensors)

    def algebra(row: dict) -> dict:
        return {**{k: row[k] for k in keys}, **_algebra(row, names, rcond, strong)}

    reduced = per_row(table, algebra, (
        f"{stats_schema(df, keys)}, n bigint, constant array<string>, condition_number double, "
        "effective_rank int, eigenvalues array<double>, redundant array<string>, "
        "pairs array<struct<grade:int,kind:string,a:string,b:string,r:double>>"))
    full = materialise(reduced.join(table.drop("n", "use", "acc"), keys))
    counted = F.transform(F.array(*map(F.lit, PAIR_KINDS)), lambda kind: F.size(
        F.filter("pairs", lambda q: q["kind"] == kind)))
    ratio = F.col("n") / F.lit(float(len(names))) if names else F.lit(None).cast("double")
    summary = full.select(
        *keys, F.col("n").alias("n_rows"), F.lit(len(names)).alias("n_sensors"),
        ratio.alias("samples_per_sensor"), "rows_non_finite", "values_non_finite", "duplicate_rows",
        "constant", "condition_number", "effective_rank", "eigenvalues", "redundant",
        counted.alias("_kinds"))
    summary = summary.withColumn("warnings", F.array_compact(F.array(*_warnings(len(names)))))
    pairs = full.select(*keys, F.inline(F.array_sort("pairs"))).drop("grade")
    return Quality(summary.drop("_kinds"), per_sensor, pairs, list(keys))


def _warnings(p: int) -> list:
    """One sentence per finding of a summary row, NULL where there is none."""
    size, kinds = F.size("constant"), F.col("_kinds")
    say = lambda hit, *parts: F.when(hit, F.concat(*[
        F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts]))
    few = F.col("samples_per_sensor") < MIN_SAMPLES_PER_SENSOR
    return [
        say(size > 0, "constant sensors carry no information: ", size),
        say(kinds[0] > 0, "sensor pairs that are exact copies: ", kinds[0]),
        say(kinds[1] > 0, "sensor pairs that are nearly collinear: ", kinds[1]),
        say(F.col("effective_rank") < p, "effective rank ", F.col("effective_rank"), f" is below the {p} sensors"),
        say(few, "few samples per sensor (", F.format_string("%.1f", "samples_per_sensor"),
            "): prefer a shrinkage estimator"),
        say(F.col("values_non_finite") > 0, "non-finite values: ", F.col("values_non_finite")),
        say(F.col("duplicate_rows") > 0, "duplicated rows: ", F.col("duplicate_rows")),
    ]


def rank_of(r: np.ndarray, rcond: float) -> tuple[float, list[float], int]:
    """Condition number (infinite when rank deficient), spectrum and rank."""
    eig = np.clip(np.linalg.eigvalsh(r)[::-1], 0.0, None)
    rank = int((eig > rcond * max(eig[0], 1e-300)).sum())
    cond = float(eig[0] / eig[-1]) if rank == len(eig) else float("inf")
    return cond, eig.tolist(), rank


def implied(linked: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Sensors that an earlier, kept one stands for; ``gone`` ones neither stand nor fall.

    Going through the sensors in order, one falls if a kept sensor before it is linked to it.
    """
    gone = gone.copy()
    for j in range(len(gone)):
        gone[j] |= bool((linked[:j, j] & ~gone[:j]).any())
    return gone


def _algebra(row: dict, names: list[str], rcond: float, strong: float) -> dict:
    """What needs the whole correlation matrix of a group: graded pairs, spectrum, redundancy."""
    use = np.asarray(row["use"], dtype=bool)
    live = [c for c, u in zip(names, use) if u]
    out = {"n": int(row["n"]), "constant": [c for c, u in zip(names, use) if not u], "condition_number": None,
           "effective_rank": 0, "eigenvalues": [], "redundant": [], "pairs": []}
    if len(live) < 2:
        return out
    r = correlation(row["acc"], len(names))[np.ix_(use, use)]
    # grade 0, 1, 2: the index of the pair's kind; 3: no pair
    grade = np.digitize(-np.abs(r), [-EXACT_DUPLICATE, -COLLINEAR, -strong], right=True)
    upper = np.triu(np.ones_like(grade, dtype=bool), 1)
    a, b = np.nonzero(upper & (grade < len(PAIR_KINDS)))
    out["pairs"] = [{"grade": int(grade[i, j]), "kind": PAIR_KINDS[grade[i, j]], "a": live[i], "b": live[j],
                     "r": float(r[i, j])} for i, j in zip(a, b)]
    copies = implied((grade == 0) & upper, np.zeros(len(live), bool))
    all_gone = implied((grade == 1) & upper, copies)
    out["redundant"] = [live[j] for j in (*np.flatnonzero(copies), *np.flatnonzero(all_gone & ~copies))]
    out["condition_number"], out["eigenvalues"], out["effective_rank"] = rank_of(r, rcond)
    return out


def correlation_cells(df: DataFrame, keys: list[str], sensors: list[str]) -> DataFrame:
    """The correlation matrix as rows ``keys, a, b, i, j, r, marked`` (marked: |r| >= 0.98)."""
    rows = clean(df, sensors, keys)
    stats = materialise(live_stats(rows, keys, sensors))
    names, p = list(sensors), len(sensors)

    def cells(row: dict) -> list[dict]:
        r = correlation(row["acc"], p)
        off = ~np.eye(p, dtype=bool)
        dead = ~np.asarray(row["use"], dtype=bool)
        r[(dead[:, None] | dead[None, :]) & off] = 0.0
        return [
            {**{k: row[k] for k in keys}, "a": names[i], "b": names[j], "i": i, "j": j,
             "r": float(r[i, j]), "marked": bool(j > i and abs(r[i, j]) >= STRONG)}
            for i in range(p) for j in range(p)
        ]

    table = correlation_sums(rows, stats, keys, sensors).select(*keys, "use", "acc")
    schema = f"{stats_schema(df, keys)}, a string, b string, i int, j int, r double, marked boolean"
    return per_row(table, cells, schema)
