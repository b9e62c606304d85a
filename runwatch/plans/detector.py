"""Detectors: one model per operating point, all fitted together.

``Detector`` is the template contract (frozen parameters, ``fit`` returns a
fitted table); ``FittedDetector`` is the table plus row-wise scoring and the
shared threshold operations.  Nothing is changed in place: every operation
returns a new object over a new model table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import flag
from ..functions.covariance import estimate, factorise, model_thresholds
from ..operators.blocks import by_group
from ..operators.distance import distances
from ..operators.gram import (
    clean, correlation, fourth_power, moments, per_row, standard_columns, standard_gram, unpack,
)
from ..operators.mcd import minimum_covariance_determinant
from ..operators.ordering import before_cut, hash_cut
from ..operators.prepare import drop_redundant, first_of_each, fit_scaler, live_stats
from ..operators.quantiles import EXACT_ROWS, grouped_quantiles
from ..operators.sums import partial_vectors, summed
from ..runtime import attach, col, materialise, stored

COVARIANCES = ("empirical", "ledoit_wolf", "oas", "mcd", "diagonal")
SCALERS = ("standard", "robust", "none")
INVERSES = ("cholesky", "eigen")
RULES = ("empirical", "chi2", "hotelling")

_MODEL_SCHEMA = (
    "op string, chain string, features_in array<string>, features_used array<string>, "
    "center array<double>, scale array<double>, location array<double>, "
    "a array<array<double>>, precision array<array<double>>, "
    "thresholds map<string,double>, alpha double, dropped map<string,string>, "
    "diagnostics struct<{diagnostics}>, warnings array<string>, n_calib bigint, "
    "use array<boolean>, shift array<double>, weight array<double>"
)
_DIAGNOSTICS = (
    "n_train bigint, n_sensors_in int, n_sensors_used int, samples_per_sensor double, "
    "cov_estimator string, inverse string, ridge double, n_components int, "
    "effective_rank int, condition_number double, spectrum array<double>, "
    "calibration_samples bigint"
)
_MODEL_SCHEMA = _MODEL_SCHEMA.format(
    diagnostics=_DIAGNOSTICS.replace(" ", ":").replace(",:", ","))


class Detector:
    """Template contract.  ``score`` of the fitted table is higher for worse runs."""

    chain: str = "default"

    def fit(self, nominal: DataFrame, sensors: list[str], run_id: str = "run_id",
            available: DataFrame | None = None) -> "FittedDetector":
        raise NotImplementedError

    def fit_predict(self, nominal: DataFrame, sensors: list[str],
                    run_id: str = "run_id") -> DataFrame:
        return self.fit(nominal, sensors, run_id).predict(nominal)


@dataclass(frozen=True)
class FittedDetector:
    """A model table (``op, chain, thresholds, threshold, rule, alpha, warnings, ...``)."""

    table: DataFrame
    axis: tuple[str, ...] = ()
    n_models: int | None = None

    # -- to implement ---------------------------------------------------------
    def score(self, df: DataFrame) -> DataFrame:
        """``df`` joined with its models: adds ``chain``, ``score`` and ``threshold``."""
        raise NotImplementedError

    def contributions(self, df: DataFrame, **options) -> DataFrame:
        """Score split over the sensors; only detectors whose score is a sum of sensor terms have it."""
        raise AttributeError(f"the score of a {type(self).__name__} is no sum over sensors")

    # -- shared ---------------------------------------------------------------
    def predict(self, df: DataFrame) -> DataFrame:
        return self.score(df).withColumn("flagged", flag(F.col("score"), F.col("threshold")))

    def false_positive_rate(self, nominal: DataFrame) -> DataFrame:
        return self.predict(nominal).groupBy("op", "chain").agg(
            F.avg(F.col("flagged").cast("double")).alias("fpr"),
            F.count(F.lit(1)).alias("n"),
        )

    def with_table(self, table: DataFrame) -> "FittedDetector":
        return replace(self, table=table)

    def use_threshold(self, name: str) -> "FittedDetector":
        """Switch every model to a rule computed at fit time."""
        lacking = self.table.where(~F.map_contains_key("thresholds", F.lit(name))).first()
        if lacking is not None:
            raise KeyError(
                f"no threshold {name!r} for {lacking['op']!r}; it has {sorted(lacking['thresholds'])}"
            )
        return self.with_table(self.table.withColumns(
            {"threshold": F.col("thresholds")[name], "rule": F.lit(name)}
        ))

    def set_threshold(self, value: float, name: str = "manual") -> "FittedDetector":
        given = F.lit(float(value))
        return self.with_table(self.table.withColumns({
            "thresholds": _put(F.col("thresholds"), name, given), "threshold": given,
            "rule": F.lit(name),
        }))

    def calibrate(self, nominal: DataFrame, alpha: float = 1e-3, name: str = "empirical",
                  exact_rows: int | None = None) -> "FittedDetector":
        """Threshold at the 1 - alpha quantile of the scores of ``nominal``."""
        found = materialise(score_quantile(self.score(nominal), alpha, exact_rows))
        if self.table.join(found, ["op", "chain"], "left_anti").first() is not None:
            raise ValueError("no finite score on the calibration set of some operating point")
        few = F.when(
            F.col("n") * F.lit(alpha) < 10,
            F.lit(f"threshold at alpha={alpha:g} rests on fewer than 10 calibration runs"),
        )
        table = self.table.join(found, ["op", "chain"]).withColumns({
            "thresholds": _put(F.col("thresholds"), name, F.col("limit")),
            "threshold": F.col("limit"), "rule": F.lit(name), "alpha": F.lit(float(alpha)),
            "warnings": F.concat("warnings", F.array_compact(F.array(few))),
        })
        return self.with_table(materialise(table.select(*self.table.columns)))

    def threshold_table(self) -> DataFrame:
        return self.table.select(
            "op", "chain", "rule", F.explode("thresholds").alias("name", "threshold")
        ).select("op", "chain", F.col("name").alias("rule"), "threshold",
                 (F.col("name") == F.col("rule")).alias("selected"))

    # -- persistence ----------------------------------------------------------
    def save(self, path: str) -> str:
        """Parquet for reading back, JSON next to it for people."""
        axis = F.array(*[F.lit(s) for s in self.axis]).cast("array<string>")
        kind = F.lit(type(self).__name__)
        self.table.withColumns({"axis": axis, "detector": kind}).write.mode("overwrite").parquet(
            f"{path}/models.parquet"
        )
        shown = [c for c in ("op", "chain", "features_in", "features_used", "threshold", "rule",
                             "alpha", "thresholds", "diagnostics", "warnings")
                 if c in self.table.columns]
        self.table.select(*shown).withColumn("detector", kind).write.mode("overwrite").json(
            f"{path}/models.json"
        )
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedDetector":
        stored = spark.read.parquet(f"{path}/models.parquet")
        first = stored.select("axis").first()
        return cls(stored.drop("axis", "detector"), tuple(first["axis"]) if first else ())


def _put(thresholds: Column, name: str, value: Column) -> Column:
    rest = F.map_filter(thresholds, lambda k, v: k != name)
    return F.map_concat(rest, F.create_map(F.lit(name), value))


def score_quantile(
    scored: DataFrame, alpha: float, exact_rows: int | None = None,
    counts: DataFrame | None = None, largest: int | None = None,
) -> DataFrame:
    """``op, chain, n, limit``: exact linear-interpolated 1 - alpha quantile of the scores."""
    if largest is None or largest > (EXACT_ROWS if exact_rows is None else exact_rows):
        # large groups are read several times: hash, join and score their runs once
        scored = stored(scored.select("op", "chain", "score"))
    q = grouped_quantiles(scored, ["op", "chain"], "score", [1.0 - alpha], counts, exact_rows,
                          largest=largest)
    return q.select("op", "chain", "n", F.col("q")[0].alias("limit"))


@dataclass(frozen=True)
class Mahalanobis(Detector):
    """Distance from the nominal cloud: estimator, scaling, factorisation, threshold rule."""

    cov: str = "ledoit_wolf"
    scaler: str = "standard"
    inverse: str = "cholesky"
    ridge: float | str | None = "auto"
    rcond: float = 1e-8
    var_explained: float | None = None
    drop_redundant_sensors: bool = True
    collinear_threshold: float = 0.999
    threshold: str = "empirical"
    alpha: float = 1e-3
    calib_fraction: float = 0.3
    support_fraction: float | None = None
    seed: int = 0
    chain: str = "default"

    def __post_init__(self) -> None:
        for name, allowed in (("cov", COVARIANCES), ("scaler", SCALERS),
                              ("inverse", INVERSES), ("threshold", RULES)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if not 0.0 < self.alpha < 1.0:
            raise ValueError("alpha must lie in (0, 1)")
        if not 0.0 <= self.calib_fraction < 1.0:
            raise ValueError("calib_fraction must lie in [0, 1)")
        if isinstance(self.ridge, str) and self.ridge != "auto":
            raise ValueError("ridge must be a number, 'auto' or None")

    # -- fitting ----------------------------------------------------------------
    def fit(self, nominal, sensors, run_id="run_id", available=None) -> "FittedMahalanobis":
        """Fit every operating point of ``nominal`` (columns ``op``, ``run_id``, sensors).

        ``available`` (``op, sensors ARRAY<STRING>``) limits the sensors per
        operating point; without it every sensor is offered everywhere.
        """
        missing = [s for s in sensors if s not in nominal.columns]
        if missing:
            raise KeyError(f"missing sensor column(s): {missing}")
        if run_id != "run_id":
            nominal = nominal.withColumnRenamed(run_id, "run_id")
        rows = clean(nominal, list(sensors), ["op", "run_id"])
        stats = self._stats(rows, list(sensors), available)
        facts = stats.agg(
            F.count(F.lit(1)).alias("ops"), F.max("n").alias("largest"), F.min("n").alias("least"),
            F.bool_or(F.exists("cnt", lambda c: c < F.col("n"))).alias("gaps"),
            F.min(F.struct(F.size(F.filter("use", lambda u: u)), "op")).alias("poorest"),
        ).first()
        if not facts["ops"] or facts["least"] < 2:
            raise ValueError("at least 2 usable nominal runs are required")
        # the first sensor with any spread is always kept
        if self.drop_redundant_sensors and facts["poorest"][0] == 0:
            raise ValueError(f"every sensor of {facts['poorest'][1]!r} is constant or redundant")
        if facts["gaps"] or self.scaler == "robust" or self.cov == "mcd":
            models, tagged, axis = self._stepwise(rows, stats, list(sensors))
        else:
            models, tagged = self._in_one_pass(rows, stats, list(sensors), facts)
            axis = list(sensors)
        table, axis = _narrow_axis(models, axis)
        fitted = self._thresholds(tagged, table, axis, facts)
        return FittedMahalanobis(
            fitted, tuple(axis), facts["ops"], self.inverse == "cholesky"
        )

    def _stats(self, rows, sensors, available):
        stats = live_stats(rows, ["op"], sensors)
        names = F.array(*[F.lit(s) for s in sensors])
        if available is None:
            return materialise(stats.withColumn("features_in", names))
        on = available.select("op", F.col("sensors").alias("_on"))
        stats = stats.join(on, "op").withColumns({
            "features_in": F.filter(names, lambda s: F.array_contains("_on", s)),
            "use": F.zip_with("use", names, lambda u, s: u & F.array_contains("_on", s)),
        })
        # a sensor that is not offered has no gaps to care about
        offered = F.transform(names, lambda s: F.array_contains("_on", s))
        return materialise(stats.withColumn("cnt", F.zip_with(
            "cnt", offered, lambda c, o: F.when(o, c).otherwise(F.col("n")))).drop("_on"))

    def _in_one_pass(self, rows, stats, sensors, facts):
        """No gaps: one scan gives the sums of the training and of the held-out rows.

        Together they decide which sensors are redundant; the training sums alone
        give scaling, covariance and (from the quartic sums) the shrinkage.
        """
        k = F.bround(F.lit(self.calib_fraction) * F.col("n")).cast("bigint")
        hold = F.lit(self.calib_fraction > 0.0)
        tiny = hold & ((k < 2) | (F.col("n") - k < 2))
        plan = stats.withColumns({"tiny": tiny, "k": F.when(hold & ~tiny, k).otherwise(0)})
        plan = plan.withColumn("n_calib", F.when(F.col("tiny"), F.col("n")).otherwise(F.col("k")))
        if self.calib_fraction > 0.0:
            cuts = hash_cut(rows, ["op"], "run_id", plan.select("op", "n", "k"), self.seed,
                            largest=facts["largest"], n_groups=facts["ops"])
            plan = materialise(plan.join(cuts, "op", "left"))
        else:
            none = F.lit(None).cast("string")
            plan = plan.withColumns({"cut_hash": none, "cut_id": none})
        marked = attach(rows, plan.select("op", "cut_hash", "cut_id", "tiny"), ["op"],
                        row_bytes=160, rows=facts["ops"])
        held = before_cut(F.col("run_id"), self.seed)
        tagged = marked.withColumns({"_held": held, "_calib": held | F.col("tiny")})
        tagged = tagged.drop("cut_hash", "cut_id", "tiny")
        sums = standard_gram(tagged, plan, ["op"], sensors, quartic=self.cov == "ledoit_wolf",
                             by=["_held"], rows=facts["ops"])
        side = lambda flag_: F.max(F.when(F.col("_held") == flag_, F.col("acc")))
        per_op = sums.groupBy("op").agg(side(False).alias("acc"), side(True).alias("acc_held"))
        table = plan.join(per_op, "op").withColumnRenamed("n", "n_all")
        params, names = asdict(self), list(sensors)
        models = per_row(table, lambda row: _solve_sums(row, params, names), _MODEL_SCHEMA)
        return materialise(models), tagged

    def _stepwise(self, rows, stats, sensors):
        """Gaps, robust scaling or MCD: sensors, rows, scaling and sums in turn."""
        plan, axis = self._choose_sensors(rows, stats, sensors)
        tagged, plan = self._tag(rows, plan, axis)
        train = tagged.where("_train")
        scaler = self._scaler(train, plan, axis)
        return self._models(train, scaler, axis), tagged, axis

    def _choose_sensors(self, rows, stats, sensors):
        """Kept sensors per operating point and the axis (their union, in column order)."""
        if self.drop_redundant_sensors:
            chosen = drop_redundant(
                rows, ["op"], sensors, self.collinear_threshold, stats=stats
            )
        else:
            chosen = stats.select(
                "op", F.col("features_in").alias("kept"),
                F.map_from_arrays(F.array(), F.array()).cast("map<string,string>").alias("dropped"),
            )
        some_null = F.exists("cnt", lambda c: c < F.col("n"))
        plan = materialise(
            stats.select("op", "n", "features_in", some_null.alias("gaps")).join(chosen, "op")
            .withColumn("dropped", F.map_filter(
                "dropped", lambda k, v: F.array_contains("features_in", k)))
        )
        used = {r[0] for r in plan.select(F.explode("kept")).distinct().collect()}
        axis = [s for s in sensors if s in used]
        mask = F.array(*[F.array_contains("kept", s) for s in axis])
        return plan.withColumn("use", mask), axis

    def _tag(self, rows, plan, axis):
        """Drop incomplete rows and mark training and calibration rows."""
        whole = [~F.col("use")[j] | col(s).isNotNull() for j, s in enumerate(axis)]
        ok = whole[0]
        for w in whole[1:]:
            ok = ok & w
        rows = rows.select("op", "run_id", *[col(s) for s in axis])
        if plan.where("gaps").isEmpty():
            plan = plan.withColumn("n_ok", F.col("n"))
        else:
            usable = attach(rows, plan.select("op", "use"), ["op"]).groupBy("op").agg(
                F.count_if(ok).alias("n_ok"))
            plan = materialise(plan.join(usable, "op"))
        short = plan.where("n_ok < 2").first()
        if short is not None:
            raise ValueError(f"fewer than 2 usable nominal runs for {short['op']!r}")
        k = F.bround(F.lit(self.calib_fraction) * F.col("n_ok")).cast("bigint")
        none = F.lit(self.calib_fraction <= 0.0)
        tiny = ~none & ((k < 2) | (F.col("n_ok") - k < 2))
        plan = plan.withColumns({"tiny": tiny, "k": F.when(none | tiny, 0).otherwise(k)})
        plan = plan.withColumn(
            "n_calib", F.when(F.col("tiny"), F.col("n_ok")).otherwise(F.col("k")))
        gap = attach(rows, plan.select("op", "use", "tiny"), ["op"]).where(ok)
        if self.calib_fraction <= 0.0:
            tagged = gap.withColumns({"_train": F.lit(True), "_calib": F.lit(False)})
        else:
            take = plan.select("op", F.col("n_ok").alias("n"), "k")
            cuts = hash_cut(gap.select("op", "run_id"), ["op"], "run_id", take, self.seed)
            plan = materialise(plan.join(cuts, "op", "left"))
            placed = attach(
                rows, plan.select("op", "use", "tiny", "cut_hash", "cut_id"), ["op"]
            ).where(ok)
            held = before_cut(F.col("run_id"), self.seed)
            tagged = placed.withColumns({
                "_calib": F.col("tiny") | held, "_train": F.col("tiny") | ~held,
            })
        # scaling, sums, MCD and thresholds read these rows many times: hash and mark them once
        return stored(tagged.drop("use", "tiny", "cut_hash", "cut_id")), plan

    def _scaler(self, train, plan, axis):
        """Scaling of the training rows, with their mean as the centre of the sums."""
        scaler = fit_scaler(train, ["op"], axis, self.scaler)
        if self.scaler == "standard":
            scaler = scaler.withColumn("mean", F.col("center"))
        else:
            mean = moments(train, ["op"], axis).select("op", "mean")
            scaler = scaler.join(mean, "op")
        zero = lambda name: F.transform(
            name, lambda v: F.coalesce(v, F.lit(0.0)))
        kept = plan.withColumnRenamed("n", "n_all").join(scaler, "op").withColumns(
            {"center": zero("center"), "mean": zero("mean")}
        )
        return materialise(kept.withColumnRenamed("center", "scaler_center"))

    def _models(self, train, scaler, axis):
        about = scaler.withColumn("center", F.col("mean"))
        columns = [f"z{j}" for j in range(len(axis))]
        sums = standard_gram(train, about, ["op"], axis)
        if self.cov == "mcd":
            robust = minimum_covariance_determinant(
                standard_columns(train, about, ["op"], axis, keep=["op", "run_id"]),
                scaler.select("op", "n", "use"), columns, self.support_fraction, self.seed,
            )
            sums = sums.join(robust, "op", "left")
        params, names = asdict(self), list(axis)
        table = scaler.drop("n").join(sums, "op")
        return materialise(per_row(table, lambda row: _solve(row, params, names), _MODEL_SCHEMA))

    def _thresholds(self, tagged, models, axis, facts):
        if self.calib_fraction <= 0.0:
            found = models.select("op").limit(0).withColumns(
                {"n": F.lit(0).cast("bigint"), "limit": F.lit(0.0)})
        else:
            held = tagged.where("_calib").select("op", *[col(s) for s in axis])
            scored = distances(
                held, models.withColumn("chain", F.lit(self.chain)), axis, ["chain"],
                triangular=self.inverse == "cholesky", rows=facts["ops"],
            ).withColumn("score", F.sqrt("d2"))
            counts = models.select("op", "chain", F.col("n_calib").alias("n"))
            found = score_quantile(
                scored, self.alpha, counts=counts, largest=facts["largest"]).drop("chain")
        few = F.when(
            F.col("n") * F.lit(self.alpha) < 10,
            F.lit(f"empirical threshold at alpha={self.alpha:g} rests on fewer than 10 "
                  "calibration runs: compare it with chi2"),
        )
        table = models.join(found, "op", "left").withColumn("thresholds", F.when(
            F.col("limit").isNotNull(), F.map_concat(
                "thresholds", F.create_map(F.lit("empirical"), F.col("limit")))
        ).otherwise(F.col("thresholds")))
        has = F.map_contains_key("thresholds", F.lit(self.threshold))
        rule = F.when(has, F.lit(self.threshold)).otherwise(F.lit("chi2"))
        swapped = F.when(~has, F.lit(f"threshold rule {self.threshold!r} unavailable: chi2 used"))
        approximate = F.when(
            (rule == "hotelling") & F.lit(self.cov != "empirical"),
            F.lit("the Hotelling limit is exact for the sample covariance only"),
        )
        table = table.withColumns({
            "rule": rule,
            "threshold": F.coalesce(
                F.try_element_at("thresholds", rule), F.col("thresholds")["chi2"]),
            "warnings": F.concat("warnings", F.array_compact(F.array(few, swapped, approximate))),
            "diagnostics": F.col("diagnostics").withField("calibration_samples", F.col("n")),
        })
        return materialise(table.drop("n", "limit", "n_calib"))


def _narrow_axis(models: DataFrame, axis: list[str]) -> tuple[DataFrame, list[str]]:
    """Keep only sensors that some model uses, so that scoring reads no others."""
    used = models.agg(*[
        F.bool_or(F.array_contains("features_used", s)).alias(f"_{j}") for j, s in enumerate(axis)
    ]).first()
    kept = [j for j in range(len(axis)) if used[j]]
    if len(kept) == len(axis):
        return models, axis
    p = len(axis)
    pick = lambda name: F.array(*[F.col(name)[j] for j in kept])
    cells = F.array(*[F.lit(i * p + j) for i in kept for j in kept])
    return models.withColumns({
        "use": pick("use"), "shift": pick("shift"),
        "weight": F.transform(cells, lambda at: F.get("weight", at)),
    }), [axis[j] for j in kept]


def _solve_sums(row: dict, params: dict, axis: list[str]) -> dict:
    """Model of one operating point from its training and held-out sums."""
    p_all = len(axis)
    acc = np.asarray(row["acc"], dtype=float)
    held = row["acc_held"]
    together = acc if held is None else acc + np.asarray(held, dtype=float)
    live = np.asarray(row["use"], dtype=bool)
    offered = set(row["features_in"])
    if params["drop_redundant_sensors"]:
        kept, dropped = first_of_each(
            np.abs(correlation(together, p_all)), live, axis, params["collinear_threshold"])
        dropped = {k: v for k, v in dropped.items() if k in offered}
    else:
        kept, dropped = [j for j, s in enumerate(axis) if s in offered], {}
    pick = np.asarray(kept)
    n, total, cross, rest = unpack(acc, p_all)
    # the sums are around the mean and in the spread of all rows; move to the training rows
    unit = np.asarray(row["scale"], dtype=float)[pick]
    about = np.asarray(row["center"], dtype=float)[pick]
    shift = total[pick] / n
    spread = np.diag(cross)[pick] / n - shift * shift
    root = np.sqrt(np.where(live[pick] & (spread > 0), spread, 1.0))
    if params["scaler"] == "none":
        center, scale, grow = np.zeros(len(pick)), np.ones(len(pick)), unit
    else:
        center, scale, grow = about + unit * shift, unit * root, 1.0 / root
    centred = (cross[np.ix_(pick, pick)] - n * np.outer(shift, shift)) * np.outer(grow, grow)
    norm4 = (fourth_power(acc, p_all, pick, shift, 1.0 / grow)
             if params["cov"] == "ledoit_wolf" else 0.0)
    cov = estimate(params["cov"], n, np.zeros(len(pick)), centred, norm4)
    location = (about + unit * shift - center) / scale
    return _model_row(row, params, axis, pick, n, center, scale, location, cov, dropped)


def _solve(row: dict, params: dict, axis: list[str]) -> dict:
    """Model of one operating point from the sums of its scaled training rows."""
    p_all = len(axis)
    pick = np.flatnonzero(np.asarray(row["use"], dtype=bool))
    n, total, cross, rest = unpack(row["acc"], p_all)
    scale = np.asarray(row["scale"], dtype=float)[pick]
    center = np.asarray(row["scaler_center"], dtype=float)[pick]
    mean = np.asarray(row["mean"], dtype=float)[pick]
    offset = (mean - center) / scale
    warnings: list[str] = []
    name = params["cov"]
    if name == "mcd" and n <= len(pick):
        warnings.append(f"{n} runs for {len(pick)} sensors are too few for MCD: Ledoit-Wolf used")
        name = "ledoit_wolf"
    if name == "mcd":
        if params["scaler"] != "robust":
            warnings.append("MCD with a scaler that is not robust: outliers still set the scale")
        if row["mcd_open"]:
            warnings.append("MCD had not settled when its steps ran out: the estimate may be poor")
        cov = np.asarray(row["mcd_cov"], dtype=float).reshape(p_all, p_all)[np.ix_(pick, pick)]
        location = offset + np.asarray(row["mcd_mean"], dtype=float)[pick]
    else:
        cov = estimate(name, n, total[pick], cross[np.ix_(pick, pick)], float(rest[0]))
        location = offset + total[pick] / n
    return _model_row(row, params, axis, pick, n, center, scale, location, cov,
                      dict(row["dropped"] or {}), warnings)


def _model_row(row, params, axis, pick, n, center, scale, location, cov, dropped, warnings=()):
    """Factor, thresholds and diagnostics, laid out as a row of the model table."""
    p_all, p = len(axis), len(pick)
    notes: list[str] = []
    if dropped:
        notes.append("redundant sensors left out: " + ", ".join(
            f"{k} ({v})" for k, v in sorted(dropped.items())))
    lost = int(row["n_all"]) - int(row.get("n_ok", row["n_all"]))
    if lost:
        notes.append(f"incomplete rows ignored while fitting: {lost}")
    if bool(row["tiny"]):
        notes.append("too few nominal runs to hold some out: the empirical threshold is in-sample")
    got = factorise(cov, params["inverse"], params["ridge"], params["rcond"],
                    params["var_explained"])
    notes += [*warnings, *got["warnings"]]
    if n < 10 * p:
        notes.append(f"few samples per sensor ({n / p:.1f}): prefer Ledoit-Wolf or fewer sensors")
    if got["rank"] < p:
        notes.append(f"nominal covariance has rank {got['rank']} of {p}")
    root = got["root"]
    k = len(root)
    weight = np.zeros((p_all, p_all))
    weight[np.ix_(pick if k == p else np.arange(k), pick)] = root / scale
    shift = np.zeros(p_all)
    shift[pick] = center + scale * location
    use = np.zeros(p_all, dtype=bool)
    use[pick] = True
    return {
        "op": row["op"], "chain": params["chain"], "features_in": list(row["features_in"]),
        "features_used": [axis[j] for j in pick], "center": center.tolist(),
        "scale": scale.tolist(), "location": location.tolist(), "a": root.tolist(),
        "precision": (root.T @ root).tolist(),
        "thresholds": model_thresholds(n, k, params["alpha"]), "alpha": params["alpha"],
        "dropped": dropped,
        "diagnostics": {
            "n_train": n, "n_sensors_in": len(row["features_in"]), "n_sensors_used": p,
            "samples_per_sensor": n / p, "cov_estimator": params["cov"],
            "inverse": params["inverse"], "ridge": got["ridge"], "n_components": k,
            "effective_rank": got["rank"], "condition_number": got["cond"],
            "spectrum": got["spectrum"].tolist(), "calibration_samples": None,
        },
        "warnings": notes, "n_calib": int(row["n_calib"]), "use": use.tolist(),
        "shift": shift.tolist(), "weight": weight.ravel().tolist(),
    }


@dataclass(frozen=True)
class FittedMahalanobis(FittedDetector):
    """Scores, exact additive contributions and the precision matrix actually used."""

    triangular: bool = False

    def _distances(self, df: DataFrame, carry: list[str], parts: bool = False) -> DataFrame:
        return distances(df, self.table, list(self.axis), carry, contributions=parts,
                         triangular=self.triangular, rows=self.n_models)

    def squared_distance(self, df: DataFrame) -> DataFrame:
        return self._distances(df, ["chain"])

    def score(self, df: DataFrame) -> DataFrame:
        joined = self._distances(df, ["chain", "threshold"])
        return joined.withColumn("score", F.sqrt("d2")).drop("d2")

    def contributions(self, df: DataFrame, normalize: bool = False) -> DataFrame:
        """Adds ``features_used`` and ``contribution ARRAY<DOUBLE>`` aligned with it."""
        joined = self._distances(df, ["chain", "threshold", "features_used"], parts=True)
        names = F.array(*[F.lit(s) for s in self.axis])
        mine = F.filter("parts", lambda v, i: F.array_contains("features_used", names[i]))
        if normalize:
            share = F.transform(
                "_mine", lambda v: F.when(F.col("d2") > 0, v / F.col("d2")).otherwise(0.0))
        else:
            share = F.col("_mine")
        return (
            joined.withColumn("_mine", mine).withColumn("contribution", share)
            .withColumn("score", F.sqrt("d2")).drop("parts", "_mine")
        )

    def contribution_rows(self, df: DataFrame, carry: list[str] | None = None) -> DataFrame:
        """Long form: ``carry, op, chain, score, threshold, sensor, contribution, share``."""
        carry = ["run_id"] if carry is None else carry
        made = self.contributions(df)
        pair = F.explode(F.arrays_zip(F.col("features_used").alias("sensor"), "contribution"))
        return made.select(*carry, "op", "chain", "score", "threshold", "d2", pair.alias("e")).select(
            *carry, "op", "chain", "score", "threshold", "e.sensor", "e.contribution",
            F.when(F.col("d2") > 0, F.col("e.contribution") / F.col("d2")).otherwise(0.0)
            .alias("share"),
        )

    def contribution_means(
        self, df: DataFrame, keys: list[str], hot: bool = False, min_score: float | None = None,
    ) -> DataFrame:
        """``keys, sensor, contribution, share, n``: means over the runs of each group that use the sensor.

        With ``hot`` only runs above their threshold (or ``min_score``) count.  The contributions of
        a run are added as one vector and split by sensor after the sums.
        """
        joined = self._distances(df, ["chain", "threshold", "features_used"], parts=True).where("d2 IS NOT NULL")
        if hot:
            limit = F.col("threshold") if min_score is None else F.lit(float(min_score))
            joined = joined.where(F.sqrt("d2") > limit)
        names, p = list(self.axis), len(self.axis)
        used = F.transform(F.array(*[F.lit(s) for s in names]), lambda s: F.array_contains("features_used", s))
        rows = joined.select(*keys, "d2", "parts", used.cast("array<double>").alias("used"))

        def vectors(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
            for key, part in by_group(batch, keys):
                at = {c: part.column(part.schema.get_field_index(c)) for c in ("d2", "parts", "used")}
                parts, used = (at[c].flatten().to_numpy(zero_copy_only=False).reshape(-1, p) for c in ("parts", "used"))
                whole = at["d2"].to_numpy()[:, None]
                share = np.divide(parts, whole, out=np.zeros_like(parts), where=whole > 0)
                yield key, np.concatenate([used.sum(axis=0), (parts * used).sum(axis=0), (share * used).sum(axis=0)])

        sums = summed(partial_vectors(rows, keys, vectors), keys)
        cut = lambda k: F.slice("acc", k * p + 1, p)
        zipped = F.arrays_zip(F.array(*[F.lit(s) for s in names]).alias("sensor"), cut(0).alias("n"),
                              cut(1).alias("c"), cut(2).alias("s"))
        return sums.select(*keys, F.explode(zipped).alias("e")).where("e.n > 0").select(
            *keys, "e.sensor", (F.col("e.c") / F.col("e.n")).alias("contribution"),
            (F.col("e.s") / F.col("e.n")).alias("share"), F.col("e.n").cast("bigint").alias("n"))

    def top_contributors(self, df: DataFrame, k: int = 5) -> DataFrame:
        """The k largest shares of every run, side by side; sorted inside the row."""
        made = self.contributions(df, normalize=True)
        pairs = F.zip_with(
            "contribution", "features_used",
            lambda c, s: F.struct((-c).alias("neg"), F.array_position("features_used", s).alias("at"),
                                  s.alias("sensor"), c.alias("share")),
        )
        best = F.slice(F.array_sort(pairs), 1, k)
        out = made.withColumn("_best", best)
        for i in range(min(k, len(self.axis))):
            item = F.get("_best", F.lit(i))
            out = out.withColumns({f"sensor_{i + 1}": item["sensor"], f"share_{i + 1}": item["share"]})
        return out.drop("_best", "contribution", "features_used", "d2")

    def precision(self) -> DataFrame:
        return self.table.select("op", "chain", "features_used", "precision")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FittedMahalanobis":
        base = FittedDetector.load.__func__(cls, spark, path)
        kinds = base.table.select("diagnostics.inverse").distinct().collect()
        return replace(base, triangular={r[0] for r in kinds} == {"cholesky"})


def combine(models: list[FittedMahalanobis]) -> FittedMahalanobis:
    """Several chains side by side over one axis, scored in one pass over the runs."""
    axis: list[str] = []
    for m in models:
        axis += [s for s in m.axis if s not in axis]
    tables = []
    for m in models:
        at = {s: j for j, s in enumerate(m.axis)}
        p = len(m.axis)
        pick = [at.get(s) for s in axis]
        lift = lambda name, empty: F.array(*[
            F.lit(empty) if j is None else F.col(name)[j] for j in pick])
        size = len(axis)
        cells = [
            F.lit(0.0) if (k >= p or j is None) else F.col("weight")[k * p + j]
            for k in range(size) for j in pick
        ]
        tables.append(m.table.withColumns({
            "use": lift("use", False), "shift": lift("shift", 0.0), "weight": F.array(*cells),
        }))
    table = tables[0]
    for t in tables[1:]:
        table = table.unionByName(t)
    same = all(m.axis == tuple(axis) and m.triangular for m in models)
    return FittedMahalanobis(
        materialise(table), tuple(axis), None, same)
