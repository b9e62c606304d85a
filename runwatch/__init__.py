"""Health monitoring and fault detection over large tables of test runs, on Spark."""

from .operators.detectability import alpha_tradeoff, fit_pod, training_floor
from .operators.ordering import split, stratified_split, subsample
from .operators.quality import check
from .operators.roles import ColumnRoles, infer_roles
from .plans.bank import ModelBank, detectability_summary, pod_analysis, score_frame
from .plans.detector import Detector, FittedDetector, FittedMahalanobis, Mahalanobis
from .plans.report import detection_report, quicklook
from .sources.catalog import catalog_runs, read_manifest, write_manifest
from .sources.dataset import Dataset, OperatingPoint
from .sources.tables import read_failures, read_nominal, read_runs
from .streaming.scoring import score_stream

__all__ = [
    "ColumnRoles", "Dataset", "Detector", "FittedDetector", "FittedMahalanobis", "Mahalanobis",
    "ModelBank", "OperatingPoint", "alpha_tradeoff", "catalog_runs", "check",
    "detectability_summary", "detection_report", "fit_pod", "infer_roles", "pod_analysis",
    "quicklook", "read_failures", "read_manifest", "read_nominal", "read_runs", "score_frame",
    "score_stream", "split", "stratified_split", "subsample", "training_floor", "write_manifest",
]
