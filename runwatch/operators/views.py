"""The tables behind every figure: rankings, trends, ellipses, projections."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, number
from ..runtime import attach, col, materialise, stored
from .binning import binned_stats, histogram, melt, stats_in_bins
from .gram import clean, correlation, per_row
from .prepare import correlation_sums, live_stats, sound_scale
from .gram import moments
from .select import ALL_CLASSES, failure_runs, nominal_runs, signed_intensity


def nominal_stats(runs: DataFrame, sensors: list[str], keys: list[str] = ["op"]) -> DataFrame:
    """``keys, center, scale`` of the nominal runs; a scale of 0 becomes 1."""
    m = moments(clean(nominal_runs(runs), sensors, keys), keys, sensors)
    return materialise(m.select(
        *keys, F.col("mean").alias("center"), sound_scale(F.col("std")).alias("scale")))


def in_sigmas(
    df: DataFrame, stats: DataFrame, sensors: list[str], keys: list[str] = ["op"],
    keep: list[str] | None = None,
) -> DataFrame:
    """Sensors as deviations from the nominal mean in nominal sigmas."""
    joined = attach(df, stats, keys, row_bytes=16 * len(sensors) + 64)
    z = [((finite(number(df, s)) - F.col("center")[j]) / F.col("scale")[j]).alias(s)
         for j, s in enumerate(sensors)]
    return joined.select(*(df.columns if keep is None else keep), *z)


def _labelled(runs: DataFrame, classes: list[str] | None) -> DataFrame:
    rows = failure_runs(runs, classes)
    return rows.withColumn(
        "class", F.coalesce(F.col("class").cast("string"), F.lit(ALL_CLASSES))
    ).withColumn("_signed", signed_intensity(rows))


def sensor_sensitivity(
    runs: DataFrame, sensors: list[str], classes: list[str] | None = None,
    high_quantile: float = 0.9, exact_rows: int | None = None,
) -> DataFrame:
    """``op, class, sensor, slope, dev_high, r, n``, steepest sensors first.

    The wide aggregate is linear in the number of sensors and only its one-row
    results are turned into rows.
    """
    from .quantiles import grouped_quantiles

    keys = ["op", "class"]
    rows = _labelled(runs, classes).withColumn("x", F.abs("_signed")).where("x is not null")
    z = in_sigmas(rows, nominal_stats(runs, sensors), sensors, keep=[*keys, "x"])
    cut = materialise(grouped_quantiles(rows, keys, "x", [high_quantile], exact_rows=exact_rows))
    z = attach(z, cut.select(*keys, F.col("q")[0].alias("_cut")), keys)
    x = F.col("x")
    aggs = [F.count(x).alias("_nx"), (F.min(x) < F.max(x)).alias("_swept")]
    for j, s in enumerate(sensors):
        v = col(s)
        paired = F.when(v.isNotNull(), x)
        spread = F.stddev_pop(paired) * F.stddev_pop(v)
        aggs += [
            F.regr_slope(v, x).alias(f"_s{j}"),
            F.avg(F.when(x >= F.col("_cut"), F.abs(v))).alias(f"_h{j}"),
            F.try_divide(F.covar_pop(v, x), spread).alias(f"_r{j}"), F.count(v).alias(f"_c{j}"),
        ]
    wide = z.groupBy(*keys).agg(*aggs).where("_nx >= 3 and _swept")
    cells = F.array(*[
        F.struct(F.lit(s).alias("sensor"), F.col(f"_s{j}").alias("slope"),
                 F.col(f"_h{j}").alias("dev_high"), F.col(f"_r{j}").alias("r"),
                 F.col(f"_c{j}").alias("n"))
        for j, s in enumerate(sensors)
    ])
    return wide.select(*keys, F.inline(cells)).orderBy(*keys, F.desc(F.abs("slope")), "sensor")


def sensitivity_topk(table: DataFrame, metric: str = "slope", top: int = 8) -> DataFrame:
    best = Window.partitionBy("op", "class").orderBy(F.desc(F.abs(metric)), "sensor")
    ranked = table.withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= top)


def most_responsive(runs: DataFrame, sensors: list[str], k: int = 6) -> DataFrame:
    """``op, sensor, deviation, rank``: largest mean |z| of the failures."""
    z = in_sigmas(failure_runs(runs), nominal_stats(runs, sensors), sensors, keep=["op"])
    wide = z.groupBy("op").agg(*[F.avg(F.abs(col(s))).alias(s) for s in sensors])
    long = wide.unpivot("op", sensors, "sensor", "deviation")
    best = Window.partitionBy("op").orderBy(F.desc_nulls_last("deviation"), "sensor")
    return long.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def trend_vs_intensity(
    runs: DataFrame, sensors: list[str], classes: list[str] | None = None, units: str = "sigma",
    signed: bool = False, n_bins: int = 12, exact_rows: int | None = None,
) -> DataFrame:
    """Median and quartiles of each sensor over quantile bins of the intensity."""
    if units not in ("sigma", "physical"):
        raise ValueError("units must be 'sigma' or 'physical'")
    if "intensity" not in runs.columns:
        raise ValueError("no intensity column")
    rows = _labelled(runs, classes)
    x = F.col("_signed") if signed else F.abs("_signed")
    rows = rows.withColumn("x", x)
    keep = ["op", "class", "x"]
    if units == "sigma":
        values = in_sigmas(rows, nominal_stats(runs, sensors), sensors, keep=keep)
    else:
        values = clean(rows, sensors, keep)
    long = melt(values, keep, sensors, "y")
    return binned_stats(long, ["op", "class", "sensor"], "x", "y", n_bins, exact_rows=exact_rows)


def score_vs_intensity(
    frame: DataFrame, n_bins: int = 12, keys: list[str] = ["op", "class"],
    exact_rows: int | None = None,
) -> DataFrame:
    """Binned scores of ``frame`` with the threshold they are compared to."""
    # bins and limits read the same stored rows: score the runs once
    rows = stored(frame.select(*keys, finite(F.col("intensity")).alias("_x"), finite(F.col("score")).alias("_y"),
                               "threshold"))
    limits = rows.groupBy(*keys).agg(F.max("threshold").alias("threshold"))
    return stats_in_bins(rows, keys, n_bins, exact_rows=exact_rows).join(limits, keys)


def sensor_histograms(
    runs: DataFrame, sensors: list[str], bins: int = 40, standardize: bool = True
) -> DataFrame:
    """Density histograms of the nominal sensors, standardised or raw."""
    rows = nominal_runs(runs)
    if standardize:
        values = in_sigmas(rows, nominal_stats(runs, sensors), sensors, keep=["op"])
    else:
        values = clean(rows, sensors, ["op"])
    return histogram(melt(values, ["op"], sensors), ["op", "sensor"], "value", bins)


def score_histograms(scored: DataFrame, bins: int = 60) -> DataFrame:
    made = histogram(scored, ["op", "set"], "score", bins)
    limits = scored.groupBy("op").agg(F.max("threshold").alias("threshold"))
    return made.join(limits, "op")


def distance_summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    s = F.col("score")
    return scored.groupBy(*keys).agg(
        F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"),
        F.max(s).alias("max"))


def detection_rates(scored: DataFrame, keys: list[str] = ["op"]) -> DataFrame:
    """``keys, nominal_rate, nominal_n, failure_rate, failure_n`` in one pass."""
    aggs = []
    for s in ("nominal", "failure"):
        mine = F.col("set") == s
        aggs += [F.avg(F.when(mine, F.col("flagged").cast("double"))).alias(f"{s}_rate"),
                 F.count_if(mine).alias(f"{s}_n")]
    return scored.groupBy(*keys).agg(*aggs)


def contribution_shares(
    models, failures: DataFrame, keys: list[str] = ["op", "class"], min_flagged: int = 3,
    min_score: float | None = None,
) -> DataFrame:
    """Mean share of d2 per sensor over the flagged runs of each class.

    ``models`` is a fitted detector with ``contribution_means``; classes with fewer flagged runs
    are left out.  ``dominant`` marks the sensor with the largest share.
    """
    means = models.contribution_means(failures, keys, hot=True, min_score=min_score)
    means = means.where(F.col("n") >= min_flagged).select(*keys, "sensor", "share", "n")
    best = Window.partitionBy(*keys).orderBy(F.desc("share"), "sensor")
    return means.withColumn("dominant", F.row_number().over(best) == 1)


def mean_contributions(models, runs: DataFrame, keys: list[str] = ["op"], top: int = 12) -> DataFrame:
    """The sensors that contribute most to the distance of each group of runs."""
    means = models.contribution_means(runs, keys).select(*keys, "sensor", "contribution")
    best = Window.partitionBy(*keys).orderBy(F.desc("contribution"), "sensor")
    return means.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def ellipse_facts(runs: DataFrame, sx: str, sy: str) -> DataFrame:
    """``op, mx, my, r1, r2, angle``: axes of the nominal cloud of two sensors."""
    rows = clean(nominal_runs(runs), [sx, sy], ["op"])
    x, y = col(sx), col(sy)
    m = rows.groupBy("op").agg(
        F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("a"),
        F.var_samp(y).alias("c"), F.covar_samp(x, y).alias("b"))
    mid, gap = (F.col("a") + F.col("c")) / 2.0, (F.col("a") - F.col("c")) / 2.0
    root = F.sqrt(gap * gap + F.col("b") * F.col("b"))
    return m.select(
        "op", "mx", "my", "a", "b", "c", F.sqrt(mid + root).alias("r1"),
        F.sqrt(F.greatest(mid - root, F.lit(0.0))).alias("r2"),
        (F.atan2(F.col("b"), gap) / 2.0).alias("angle"),
    )


def ellipse_points(
    facts: DataFrame, sigma: float = 3.0, n_points: int = 400
) -> DataFrame:
    """The traced ellipse ``op, point, x, y`` at ``sigma`` standard deviations."""
    step = 2.0 * math.pi / (n_points - 1)
    trace = facts.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("point"))
    t = F.col("point") * F.lit(step)
    u = F.lit(float(sigma)) * F.col("r1") * F.cos(t)
    v = F.lit(float(sigma)) * F.col("r2") * F.sin(t)
    ca, sa = F.cos("angle"), F.sin("angle")
    return trace.select(
        "op", "point", (F.col("mx") + u * ca - v * sa).alias("x"),
        (F.col("my") + u * sa + v * ca).alias("y"))


def inside_ellipse(
    df: DataFrame, facts: DataFrame, sx: str, sy: str, sigma: float = 3.0
) -> DataFrame:
    """Adds ``inside``: whether the run lies within the sigma ellipse of its op."""
    joined = attach(df, materialise(facts), ["op"])
    dx, dy = number(df, sx) - F.col("mx"), number(df, sy) - F.col("my")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    d2 = F.try_divide(c * dx * dx - F.lit(2.0) * b * dx * dy + a * dy * dy, a * c - b * b)
    return joined.withColumn("inside", d2 <= F.lit(float(sigma) ** 2)).select(*df.columns, "inside")


def zoom(df: DataFrame, sx: str, sy: str, xlim: tuple, ylim: tuple) -> DataFrame:
    return df.where(col(sx).between(*xlim) & col(sy).between(*ylim))


def fit_pca(runs: DataFrame, sensors: list[str], n_components: int = 2) -> DataFrame:
    """``op, center, scale, axes, ratio`` from the nominal runs of every op.

    The sign of a component makes its largest loading positive.
    """
    rows = clean(nominal_runs(runs), sensors, ["op"])
    stats = materialise(live_stats(rows, ["op"], sensors))
    p, k = len(sensors), min(n_components, len(sensors))

    def solve(row: dict) -> dict:
        live = np.asarray(row["use"], dtype=bool)
        r = correlation(row["acc"], p)
        r[~live, :] = 0.0
        r[:, ~live] = 0.0
        val, vec = np.linalg.eigh(r)
        val, vec = np.clip(val[::-1], 0.0, None), vec[:, ::-1]
        axes = []
        for i in range(k):
            v = vec[:, i]
            axes.append((v * np.sign(v[np.argmax(np.abs(v))])).tolist())
        ratio = (val[:k] / val.sum()).tolist() if val.sum() > 0 else [0.0] * k
        return {"op": row["op"], "center": list(row["center"]), "scale": list(row["scale"]),
                "axes": axes, "ratio": ratio}

    table = correlation_sums(rows, stats, ["op"], sensors).select("op", "center", "scale", "use", "acc")
    return materialise(per_row(
        table, solve, "op string, center array<double>, scale array<double>, "
        "axes array<array<double>>, ratio array<double>"))


def project_pca(
    df: DataFrame, pca: DataFrame, sensors: list[str], keep: list[str], n_components: int = 2
) -> DataFrame:
    """``keep, pc1, pc2, ...`` of every run in the axes of its operating point."""
    joined = attach(df, pca.select("op", "center", "scale", "axes"), ["op"],
                    row_bytes=8 * len(sensors) * (n_components + 2))
    z = joined.select(*keep, "axes", *[
        ((finite(number(df, s)) - F.col("center")[j]) / F.col("scale")[j]).alias(f"_z{j}")
        for j, s in enumerate(sensors)])
    score = lambda i: sum(
        (F.col("axes")[i][j] * F.col(f"_z{j}") for j in range(len(sensors))), F.lit(0.0))
    return z.select(*keep, *[score(i).alias(f"pc{i + 1}") for i in range(n_components)])
