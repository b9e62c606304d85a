"""Reports as named tables, written under ``out/<table>/op=<name>/``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import FAILURE, NOMINAL
from ..operators import quality, views
from ..operators import select as sel
from ..operators.roles import infer_roles
from ..runtime import materialise
from ..sources.dataset import Dataset, OperatingPoint
from ..sources.tables import read_runs
from .bank import ModelBank, pod_analysis, score_frame


@dataclass
class Report:
    tables: dict[str, DataFrame]
    notes: list[str] = field(default_factory=list)

    def write(self, out: str) -> list[str]:
        """One Parquet folder per table, partitioned by operating point.

        A table that cannot be computed is named in the notes, and the others are
        written; only when none can be is the first error raised.
        """
        paths, errors = [], []
        for name, df in self.tables.items():
            path = f"{out.rstrip('/')}/{name}"
            writer = df.write.mode("overwrite")
            try:
                (writer.partitionBy("op") if "op" in df.columns else writer).parquet(path)
            except PySparkException as error:
                errors.append(error)
                self.notes.append(f"table {name} left out: {str(error).splitlines()[0]}")
            else:
                paths.append(path)
        if errors and not paths:
            raise errors[0]
        return paths


def as_dataset(spark: SparkSession, target) -> Dataset:
    """A dataset, one operating point, a bare table or the path of a CSV.

    A table without a label is all nominal; with one, the same rows serve as both
    the nominal and the failure side.
    """
    if isinstance(target, Dataset):
        return target
    if isinstance(target, OperatingPoint):
        return Dataset(target.runs, {target.name: target.roles}, load_info={target.name: target.load_info})
    name = "table"
    if isinstance(target, str):
        name = target.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        target = read_runs(spark, target).df
    if not isinstance(target, DataFrame):
        raise TypeError("quicklook takes a Dataset, an OperatingPoint, a DataFrame or a CSV path")
    roles = infer_roles(target)
    return Dataset.from_frames(
        target, target if roles.label else None, name, label=roles.label or "none",
        intensity=roles.intensity or "none")


def quicklook(
    spark: SparkSession, target, out: str | None = None, trend_sensors: int = 6,
) -> Report:
    """What is in the data: roles, quality, distributions, correlation, PCA, trends.

    The tables hold every sensor and class; only the trends are about the sensors
    that respond most, ``trend_sensors`` of each operating point.
    """
    ds = as_dataset(spark, target)
    runs, sensors = ds.runs, ds.all_sensors()
    nominal, failures = sel.nominal_runs(runs), sel.failure_runs(runs)
    report = Report({"roles": ds.roles_table(), "role_notes": ds.role_notes(), "summary": ds.summary()})
    add = report.tables
    both = quality.check(runs.where(F.col("set").isin(NOMINAL, FAILURE)), ["op", "set"], sensors)
    add["quality"], add["quality_sensors"] = both.summary, both.sensors
    add["quality_pairs"] = both.pairs
    add["spectrum"] = both.spectrum().where(F.col("set") == NOMINAL)
    add["histograms"] = views.sensor_histograms(runs, sensors)
    add["correlation"] = quality.correlation_cells(nominal, ["op"], sensors)
    if ds.load_info:
        rows = [(op, side, i["path"], i["rows_read"], i["rows_dropped"], i["rows_with_non_finite"])
                for op, sides in ds.load_info.items() for side, i in sides.items()]
        if rows:
            add["load_info"] = spark.createDataFrame(
                rows, "op string, set string, path string, rows_read bigint, "
                "rows_dropped bigint, rows_with_non_finite bigint")
    if failures.isEmpty():
        report.notes.append("no failure runs")
    else:
        add["class_counts"] = sel.class_counts(runs)
        pca = views.fit_pca(runs, sensors)
        add["pca_axes"] = pca
        add["pca"] = views.project_pca(runs, pca, sensors, ["run_id", "op", "set", "class"])
        if ds.has_intensity:
            add["intensity"] = sel.describe_intensity(failures)
            top = views.most_responsive(runs, sensors, trend_sensors)
            add["most_responsive"] = top
            chosen = {r[0] for r in top.select("sensor").distinct().collect()}
            add["trends"] = views.trend_vs_intensity(runs, [s for s in sensors if s in chosen])
        else:
            report.notes.append("no intensity column: trends left out")
    if out is not None:
        report.write(out)
    return report


def detection_report(
    bank: ModelBank, dataset: Dataset, out: str | None = None, at_alpha: float | None = None,
    classes: list[str] | None = None, n_boot: int = 200,
) -> tuple[Report, ModelBank]:
    """Detection and detectability tables; also returns the bank in force.

    With ``at_alpha`` the models of the dataset's operating points are recalibrated on
    its nominal runs first.  The bank given is not changed.
    """
    runs = dataset.runs
    if at_alpha is not None:
        bank = bank.recalibrated(sel.nominal_runs(runs), at_alpha)
    models = bank.models
    scored = materialise(bank.score_dataset(runs))
    report = Report({"models": bank.to_frame(), "thresholds": models.threshold_table()})
    add = report.tables
    add["rates"] = views.detection_rates(scored, ["op", "chain"])
    add["warnings"] = models.table.select("op", "chain", F.explode("warnings").alias("warning"))
    add["scores"] = views.score_histograms(scored)
    failures = sel.failure_runs(runs, classes)
    if failures.isEmpty():
        report.notes.append("no failure runs")
    else:
        add["contribution_shares"] = views.contribution_shares(models, failures)
        if dataset.has_intensity:
            pod = pod_analysis(models, runs, classes, n_boot=n_boot)
            add["pod"] = pod.result
            add["pod_bins"], add["pod_curve"] = pod.bins, pod.curve()
            frame = materialise(score_frame(models, runs, classes))
            add["score_vs_intensity"] = views.score_vs_intensity(frame)
            known = runs.join(models.table.select("op").distinct(), "op", "left_semi")
            add["sensitivity"] = views.sensor_sensitivity(known, dataset.all_sensors(), classes)
        else:
            report.notes.append("no intensity column: POD skipped")
    if out is not None:
        report.write(out)
    return report, bank
