"""One model per operating point, used over whole datasets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import FAILURE, NOMINAL, flag
from ..operators import detectability as det
from ..operators.quantiles import grouped_quantiles
from ..operators.select import ALL_CLASSES, UNLABELLED, failure_runs, nominal_runs, signed_intensity
from ..runtime import attach, materialise
from ..sources.dataset import Dataset
from .detector import Detector, FittedDetector, FittedMahalanobis, combine, score_quantile


class ModelBank:
    """Routes runs to the model of their operating point by a join on ``op``."""

    def __init__(self, models: FittedDetector) -> None:
        self.models = models

    @classmethod
    def fit(
        cls, dataset: Dataset, template: Detector | list[Detector],
        operating_points: list[str] | None = None, sensors: list[str] | None = None,
    ) -> "ModelBank":
        """Fit every operating point in the same jobs; the template is not changed.

        ``sensors`` forces one list everywhere and fails where it is not available.
        A list of templates makes a bank of several chains, scored in one pass.
        """
        names = dataset.operating_points if operating_points is None else list(operating_points)
        dataset.require(names, sensors or [])
        nominal = nominal_runs(dataset.runs)
        offered = None
        if operating_points is not None:
            nominal = nominal.where(F.col("op").isin(names))
        if sensors is None:
            lists = {tuple(dataset.roles[n].sensors) for n in names}
            if len(lists) > 1:
                offered = materialise(dataset.sensor_lists())
            sensors = dataset.all_sensors()
        templates = template if isinstance(template, list) else [template]
        fitted = [t.fit(nominal, list(sensors), available=offered) for t in templates]
        return cls(fitted[0] if len(fitted) == 1 else combine(fitted))

    # -- access ---------------------------------------------------------------
    @property
    def operating_points(self) -> list[str]:
        rows = self.models.table.select("op").distinct().orderBy("op").collect()
        return [r[0] for r in rows]

    def __contains__(self, name: str) -> bool:
        return not self.models.table.where(F.col("op") == name).isEmpty()

    def __len__(self) -> int:
        return self.models.table.select("op").distinct().count()

    def __iter__(self) -> Iterator[str]:
        return iter(self.operating_points)

    def __getitem__(self, name: str) -> FittedDetector:
        if name not in self:
            raise KeyError(f"no model for operating point {name!r}; known: {self.operating_points}")
        return self.models.with_table(self.models.table.where(F.col("op") == name))

    def put(self, name: str, model: FittedMahalanobis) -> "ModelBank":
        """A new bank with the model of one operating point replaced or added."""
        rest = self.models.with_table(self.models.table.where(F.col("op") != name))
        own = model.with_table(model.table.withColumn("op", F.lit(name)))
        return ModelBank(combine([rest, own]))

    def check_known(self, runs: DataFrame) -> None:
        """Raise when the runs name an operating point that has no model."""
        unknown = runs.select("op").distinct().join(
            self.models.table.select("op").distinct(), "op", "left_anti")
        first = unknown.orderBy("op").take(20)
        if first:
            names = ", ".join(repr(r[0]) for r in first)
            raise KeyError(f"no model for {unknown.count()} operating point(s), first of them: {names}")

    def recalibrated(self, nominal: DataFrame, alpha: float) -> "ModelBank":
        """Models whose operating point occurs in ``nominal`` calibrated on it, the others as they are."""
        here = nominal.select("op").distinct()
        models = self.models
        ours = models.with_table(materialise(models.table.join(here, "op", "left_semi")))
        others = models.table.join(here, "op", "left_anti").select(*models.table.columns)
        table = ours.calibrate(nominal, alpha).table.unionByName(others)
        return ModelBank(models.with_table(materialise(table)))

    # -- use --------------------------------------------------------------------
    def score(self, df: DataFrame, op: str | None = None) -> DataFrame:
        """Scores of runs with an ``op`` column, or of sensor rows that all belong to ``op``."""
        return self.models.score(self._routed(df, op))

    def predict(self, df: DataFrame, op: str | None = None) -> DataFrame:
        return self.models.predict(self._routed(df, op))

    def _routed(self, df: DataFrame, op: str | None) -> DataFrame:
        if op is None:
            return df
        if op not in self:
            raise KeyError(f"no model for operating point {op!r}; known: {self.operating_points}")
        return df.withColumn("op", F.lit(op))

    def contributions(self, df: DataFrame, **options) -> DataFrame:
        return self.models.contributions(df, **options)

    def score_dataset(self, dataset: Dataset | DataFrame) -> DataFrame:
        """``run_id, op, set, class, intensity, chain, score, threshold, flagged``.

        Operating points without a model are left out (inner join).
        """
        runs = dataset.runs if isinstance(dataset, Dataset) else dataset
        label = F.when(F.col("set") == NOMINAL, "NOMINAL").otherwise(
            F.coalesce(F.col("class").cast("string"), F.lit(UNLABELLED)))
        x = F.when(F.col("set") == FAILURE, signed_intensity(runs))
        rows = runs.withColumns({"class": label, "intensity": x})
        return self.predict(rows).select(
            "run_id", "op", "set", "class", "intensity", "chain", "score", "threshold", "flagged")

    def to_frame(self) -> DataFrame:
        d = F.col("diagnostics")
        return self.models.table.select(
            "op", "chain", F.lit(type(self.models).__name__).alias("model"),
            d["n_train"].alias("n_train"), F.size("features_used").alias("sensors_used"),
            d["effective_rank"].alias("effective_rank"), d["condition_number"].alias("cond"),
            "rule", "threshold", F.size("warnings").alias("warnings"),
        ).orderBy("op", "chain")

    def with_models(self, models: FittedDetector) -> "ModelBank":
        return ModelBank(models)

    def save(self, path: str) -> str:
        return self.models.save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ModelBank":
        return cls(FittedMahalanobis.load(spark, path))


def score_frame(
    models: FittedDetector, runs: DataFrame, classes: list[str] | None = None,
    at_alpha: float | list[float] | None = None, nominal: DataFrame | None = None,
    exact_rows: int | None = None,
) -> DataFrame:
    """Failure runs ready for POD: ``run_id, op, chain, class, intensity,
    intensity_signed, score, detected, threshold, alpha``.

    With ``at_alpha`` the threshold is the 1 - alpha quantile of the nominal
    scores (several rates give one row per run and rate); the models stay as
    they are.
    """
    scored = _scored_failures(models, runs, classes)
    if at_alpha is None:
        limits = materialise(models.table.select("op", "chain", "alpha"))
    else:
        alphas = at_alpha if isinstance(at_alpha, list) else [at_alpha]
        base = models.score(nominal_runs(runs) if nominal is None else nominal)
        limits = materialise(_limits(base, alphas, exact_rows))
        scored = scored.drop("threshold")
    made = attach(scored, limits, ["op", "chain"])
    return made.withColumn("detected", flag(F.col("score"), F.col("threshold"))).select(
        "run_id", "op", "chain", "class", "intensity", "intensity_signed", "score", "detected",
        "threshold", "alpha")


def _scored_failures(models: FittedDetector, runs: DataFrame, classes: list[str] | None) -> DataFrame:
    if "intensity" not in runs.columns:
        raise ValueError("detectability needs an intensity column")
    rows = failure_runs(runs, classes)
    return models.score(rows.withColumns({
        "class": F.coalesce(F.col("class").cast("string"), F.lit(ALL_CLASSES)),
        "intensity_signed": signed_intensity(rows),
    }).withColumn("intensity", F.abs("intensity_signed")))


def _limit_arrays(scored: DataFrame, alphas: list[float], exact_rows: int | None) -> DataFrame:
    """``op, chain, limits ARRAY<STRUCT<alpha, threshold>>`` from nominal scores."""
    q = grouped_quantiles(scored, ["op", "chain"], "score", [1.0 - a for a in alphas],
                          exact_rows=exact_rows)
    pair = lambda a, t: F.struct(a.alias("alpha"), t.alias("threshold"))
    rates = F.array(*[F.lit(float(a)) for a in alphas])
    return q.select("op", "chain", F.zip_with(rates, "q", pair).alias("limits"))


def _limits(scored: DataFrame, alphas: list[float], exact_rows: int | None) -> DataFrame:
    arrays = _limit_arrays(scored, alphas, exact_rows)
    return arrays.select("op", "chain", F.inline("limits"))


def pod_analysis(
    models: FittedDetector, runs: DataFrame, classes: list[str] | None = None,
    at_alpha: float | list[float] | None = None, nominal: DataFrame | None = None, **options,
) -> det.Pod:
    """POD of every class of every operating point (and chain and rate) at once."""
    if not isinstance(at_alpha, list):
        frame = score_frame(models, runs, classes, at_alpha, nominal)
        return det.fit_pod(frame, ["op", "chain", "class"], **options)
    base = models.score(nominal_runs(runs) if nominal is None else nominal)
    limits = materialise(_limit_arrays(base, at_alpha, options.get("exact_rows")))
    frame = attach(_scored_failures(models, runs, classes), limits, ["op", "chain"])
    cells = det.detection_cells_at(frame, ["op", "chain", "class"], len(at_alpha))
    return det.pod_of_cells(cells, ["op", "chain", "alpha", "class"], ["threshold"], **options)


def detectability_summary(
    bank: ModelBank, dataset: Dataset | DataFrame, at_alpha: float | None = None, **options
) -> DataFrame:
    """The POD table of every operating point that has a model."""
    runs = dataset.runs if isinstance(dataset, Dataset) else dataset
    return pod_analysis(bank.models, runs, at_alpha=at_alpha, **options).table()
