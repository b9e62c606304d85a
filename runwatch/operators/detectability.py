"""Probability of detection against fault intensity, for every class at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, flag, sigmoid
from ..functions.distributions import normal_quantile
from ..runtime import attach, materialise
from .binning import assign_bins, bin_edges
from .logistic import fit_groups
from .quantiles import grouped_quantiles


@dataclass
class Pod:
    """``result``: one row per group; ``bins``: empirical curve with intervals; ``fits``: with draws."""

    result: DataFrame
    bins: DataFrame
    keys: list[str]
    fits: DataFrame | None = None

    def replicates(self) -> DataFrame:
        """``keys, replicate, i90``: a row per bootstrap fit, numbered from 1; NULL where the fit
        did not converge or does not rise.  Groups without a fit of their own have none."""
        good = self.result.where(F.col("fitted") & ~F.col("separated")).select(*self.keys)
        same = [F.col(f"f.`{k}`").eqNullSafe(F.col(f"g.`{k}`")) for k in self.keys]
        mine = self.fits.alias("f").join(good.alias("g"), same, "left_semi")
        return mine.select(*self.keys, F.posexplode("boot_i90").alias("replicate", "i90")).withColumn(
            "replicate", F.col("replicate") + 1)

    def table(self, sort_by: str = "i90") -> DataFrame:
        """Hardest classes first; a missing value sorts before every number."""
        shown = [
            *self.keys, "state", "n", "detected", "detection_rate", "i50", "i90", "i90_95",
            "i50_emp", "i90_emp", "i_max", "fitted", "separated",
        ]
        groups = [k for k in self.keys if k != "class"]
        return self.result.select(*shown).orderBy(*groups, F.desc_nulls_first(sort_by), "class")

    def curve(self, points: int = 200) -> DataFrame:
        """Fitted curve on a geometric grid over the sweep: ``keys, point, intensity, pod``."""
        low = F.greatest("i_min", F.lit(1e-12))
        ratio = F.ln(F.col("i_max") / low) / F.lit(points - 1.0)
        rising = self.result.where(F.col("fitted") & (F.col("b1") > 0))
        grid = rising.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        grid = grid.withColumn("intensity", low * F.exp(ratio * F.col("point")))
        return grid.select(
            *self.keys, "point", "intensity",
            pod_at(F.col("b0"), F.col("b1"), F.col("intensity"), F.col("fitted")).alias("pod"),
            "i90", "i90_95",
        )

    def evaluate(self, grid: DataFrame) -> DataFrame:
        """POD at the intensities of ``grid`` (``keys..., intensity``)."""
        facts = materialise(self.result.select(*self.keys, "b0", "b1", "fitted"))
        pod = pod_at(F.col("b0"), F.col("b1"), F.col("intensity"), F.col("fitted"))
        return attach(grid, facts, self.keys).withColumn("pod", pod).drop("b0", "b1", "fitted")


def pod_at(b0: Column, b1: Column, intensity: Column, fitted: Column) -> Column:
    return F.when(fitted & (intensity > 0), sigmoid(b0 + b1 * F.ln(intensity)))


def wilson(k: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Score interval of k hits in n; it always contains k/n, and is NULL for n = 0."""
    z = normal_quantile(0.5 + confidence / 2.0)
    size = F.when(n > 0, n.cast("double"))
    p = k / size
    wide = F.lit(1.0) + F.lit(z * z) / size
    mid = (p + F.lit(z * z / 2.0) / size) / wide
    half = F.lit(z) * F.sqrt(
        p * (F.lit(1.0) - p) / size + F.lit(z * z / 4.0) / (size * size)) / wide
    lo = F.when(k == 0, F.lit(0.0)).otherwise(F.least(F.greatest(mid - half, F.lit(0.0)), p))
    hi = F.when(k == n, F.lit(1.0)).otherwise(F.greatest(F.least(mid + half, F.lit(1.0)), p))
    return F.when(n > 0, lo), F.when(n > 0, hi)


def invert(b0: Column, b1: Column, target: float) -> Column:
    """Intensity where the fit equals ``target``; NULL when it never rises to it."""
    logit = F.ln(F.lit(target / (1.0 - target)))
    log_i = F.when(b1 > 0, (logit - b0) / b1)
    return F.when(log_i <= 700.0, F.exp(log_i))


def detection_cells(frame: DataFrame, keys: list[str], carry: list[str] = []) -> DataFrame:
    """The sufficient statistic ``keys, intensity, n, k``, combined before the shuffle.

    Everything below reads these cells, so the runs are scored exactly once; ``carry``
    names columns that are constant in a group and come along.
    Missing intensities share one NULL cell per group.
    """
    return materialise(
        frame.select(*keys, finite(F.col("intensity")).alias("intensity"), "detected", *carry)
        .groupBy(*keys, "intensity")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("detected").alias("k"),
             *[F.max(c).alias(c) for c in carry])
    )


def detection_cells_at(frame: DataFrame, keys: list[str], rates: int) -> DataFrame:
    """``detection_cells`` at several false positive rates from one aggregate: ``alpha, keys, intensity,
    n, k, threshold``.

    ``frame`` is ``keys, intensity, score, limits ARRAY<STRUCT<alpha, threshold>>`` with ``rates``
    limits, constant in a group.  A run is counted once; the rates are set apart after the sums.
    """
    limit = lambda i: F.get("limits", F.lit(i))["threshold"]
    counted = (
        frame.select(*keys, finite(F.col("intensity")).alias("intensity"), "score", "limits")
        .groupBy(*keys, "intensity")
        .agg(F.count(F.lit(1)).alias("n"), F.first("limits").alias("limits"),
             F.array(*[F.count_if(flag(F.col("score"), limit(i))) for i in range(rates)]).alias("k"))
    )
    each = F.explode(F.zip_with("limits", "k", lambda a, k: F.struct(
        a["alpha"].alias("alpha"), a["threshold"].alias("threshold"), k.alias("k"))))
    return materialise(counted.select(*keys, "intensity", "n", each.alias("e")).select(
        "e.alpha", *keys, "intensity", "n", "e.k", "e.threshold"))


def empirical_pod(
    cells: DataFrame, keys: list[str], n_bins: int = 10, min_count: int = 15,
    confidence: float = 0.95, exact_rows: int | None = None,
) -> DataFrame:
    """``keys, bin, center, lo, hi, n, k, rate, ci_lo, ci_hi`` over quantile bins."""
    rows = cells.where(F.col("intensity") > 0)
    edges = bin_edges(rows, keys, "intensity", n_bins, min_count, "n", exact_rows)
    placed = assign_bins(rows, edges, keys, "intensity")
    cell = [*keys, "bin", "lo", "hi"]
    sums = placed.groupBy(*cell).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    middle = grouped_quantiles(
        placed, cell, "intensity", [0.5], exact_rows=exact_rows, weight="n", largest=edges.largest)
    both = sums.join(middle.select(*cell, F.col("q")[0].alias("center")), cell)
    lo, hi = wilson(F.col("k"), F.col("n"), confidence)
    return both.select(
        *keys, "bin", "center", "lo", "hi", "n", "k", (F.col("k") / F.col("n")).alias("rate"),
        lo.alias("ci_lo"), hi.alias("ci_hi"),
    )


def empirical_crossing(
    bins: DataFrame, keys: list[str], targets: dict[str, float]
) -> DataFrame:
    """Smallest bin centre from which the rate stays at or above each target."""
    from_right = Window.partitionBy(*keys).orderBy(F.desc("center")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    lowest = bins.withColumn("_floor", F.min("rate").over(from_right))
    return lowest.groupBy(*keys).agg(*[
        F.min(F.when(F.col("_floor") >= t, F.col("center"))).alias(name)
        for name, t in targets.items()
    ])


def fit_pod(
    frame: DataFrame, keys: list[str] = ["op", "class"], n_bins: int = 10, min_count: int = 15,
    n_boot: int = 200, confidence: float = 0.95, seed: object = 0,
    exact_rows: int | None = None, cells_per_task: int | None = None,
) -> Pod:
    """POD of every group of ``frame`` (``keys, intensity, detected, threshold, alpha``)."""
    settings = [c for c in ("threshold", "alpha") if c in frame.columns and c not in keys]
    return pod_of_cells(detection_cells(frame, keys, settings), keys, settings, n_bins, min_count, n_boot,
                        confidence, seed, exact_rows, cells_per_task)


def pod_of_cells(
    whole: DataFrame, keys: list[str], settings: list[str] = [], n_bins: int = 10, min_count: int = 15,
    n_boot: int = 200, confidence: float = 0.95, seed: object = 0,
    exact_rows: int | None = None, cells_per_task: int | None = None,
) -> Pod:
    """POD of every group of materialised cells (``keys, intensity, n, k`` and constant ``settings``)."""
    cells = whole.drop(*settings)
    x = F.col("intensity")
    usable = x > 0
    on = lambda c: F.sum(F.when(usable, c).otherwise(0))
    totals = materialise(whole.groupBy(*keys).agg(
        on(F.col("n")).alias("n"), on(F.col("k")).alias("detected"),
        F.sum(F.when(x <= 0, F.col("n")).otherwise(0)).alias("n_zero"),
        F.sum(F.when(x.isNull(), F.col("n")).otherwise(0)).alias("n_missing"),
        F.min(F.when(usable, x)).alias("i_min"), F.max(F.when(usable, x)).alias("i_max"),
        *[F.max(c).alias(c) for c in settings],
    ))
    bins = materialise(empirical_pod(cells, keys, n_bins, min_count, confidence, exact_rows))
    crossings = empirical_crossing(bins, keys, {"i50_emp": 0.5, "i90_emp": 0.9})
    seen = totals.where("detected > 0").select(*keys)
    fits = materialise(fit_groups(
        attach(cells.where(usable), seen, keys), keys, n_boot, confidence, seed, cells_per_task,
    ))
    table = totals.join(crossings, keys, "left").join(fits, keys, "left")
    return Pod(materialise(_conclude(table, keys, n_boot, settings)), bins, list(keys), fits)


def _conclude(table: DataFrame, keys: list[str], n_boot: int, settings: list[str]) -> DataFrame:
    n, hits = F.col("n"), F.col("detected")
    separated = (n > 0) & (hits == n)
    fitted = F.coalesce("converged", F.lit(False)) & F.col("b0").isNotNull()
    state = (
        F.when(n == 0, "no data").when(hits == 0, "never detected")
        .when(separated, "always detected").when(fitted, "fitted").otherwise("not fitted")
    )
    table = table.withColumns({
        "state": state, "fitted": fitted, "separated": separated,
        "detection_rate": F.when(n > 0, hits / n),
    })
    usable = F.col("fitted") & ~F.col("separated")
    table = table.withColumns({
        "i50": F.when(usable, invert(F.col("b0"), F.col("b1"), 0.5)),
        "i90": F.when(usable, invert(F.col("b0"), F.col("b1"), 0.9)),
        "i90_95": F.when(usable & F.lit(n_boot > 0), F.col("bound")),
    })
    number = lambda c: F.format_string("%.4g", c)
    tried = hits > 0
    notes = F.array_compact(F.array(
        F.when(F.col("n_zero") > 0, F.concat(
            F.lit("runs with zero intensity left out: "), F.col("n_zero"))),
        F.when(F.col("n_missing") > 0, F.concat(
            F.lit("runs without intensity left out: "), F.col("n_missing"))),
        F.when(n == 0, F.lit("no usable run")),
        F.when((n > 0) & (hits == 0), F.concat(
            F.lit("never detected in the sweep: i90 is beyond "), number(F.col("i_max")))),
        F.when(F.col("separated"), F.concat(
            F.lit("always detected, from the lowest intensity "), number(F.col("i_min")))),
        F.when(tried & ~F.coalesce("converged", F.lit(False)), F.lit("the fit did not converge")),
        F.when(F.col("fitted") & (F.col("b1") <= 0), F.lit(
            "detection does not rise with intensity")),
        F.when(usable & F.lit(n_boot > 0) & F.col("bound").isNull(), F.concat(
            F.lit("too few usable bootstrap fits for a bound: "), F.col("n_usable"))),
        F.when(F.col("i90") > F.col("i_max"), F.concat(
            F.lit("i90 is an extrapolation beyond the sweep, which ends at "),
            number(F.col("i_max")))),
    ))
    return table.select(
        *keys, "state", "n", "detected", "detection_rate", "i50", "i90", "i90_95",
        "i50_emp", "i90_emp", "i_min", "i_max", "b0", "b1", "fitted", "separated",
        *settings, notes.alias("notes"),
    )


def alpha_tradeoff(pod: Pod, by: list[str] = ["op", "alpha"]) -> DataFrame:
    """Per false positive rate: median and worst i90 and how many are finite."""
    return pod.result.groupBy(*by).agg(
        F.median("i90").alias("median_i90"), F.max("i90").alias("worst_i90"),
        F.count("i90").alias("n_finite"), F.count(F.lit(1)).alias("n_classes"),
    )


def training_floor(pod: Pod) -> DataFrame:
    """Intensity worth training above: the smaller of i50 and i90, missing ones skipped."""
    return pod.result.select(*pod.keys, "i50", "i90", F.least("i50", "i90").alias("train_above"))
