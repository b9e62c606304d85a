"""Reading run tables from CSV, with every lost row counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite, parsed
from ..operators.roles import is_numeric
from ..runtime import col, visible

# fixed values: cell texts that mean "missing"
NA_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# fixed values: the sensors of the built-in single-table layout
SENSOR_NAMES = (
    "Pc", "HPFTP_w", "HPOTP_w", "LPFTP_w", "LPOTP_w", "PBOBP_w",
    "Pc_FPB", "Pc_OPB", "MFV_m", "MOV_m", "OPOV_m", "FPOV_m",
    "T_Nozzle_Cooling_exit", "HGM_Temp", "Man_OX_Temp", "Man_H2_Temp",
    "Man_MCC_COOL_Pres", "HPFTP_p_pump_out", "HPOTP_p_pump_out",
    "LPFTP_p_pump_out", "LPOTP_p_pump_out", "PBOBP_p_pump_out",
    "HPFTP_T_turb_inlet", "HPOTP_T_turb_inlet",
    "LPFTP_T_turb_inlet", "LPOTP_T_turb_inlet",
)


@dataclass
class RunTable:
    """``df`` plus ``info``: path, rows_read, rows_dropped, rows_with_non_finite."""

    df: DataFrame
    info: dict


def cell(name: str) -> Column:
    """The cell as it stands, NULL where its trimmed text means missing."""
    return F.when(~F.trim(col(name)).isin(*NA_TEXTS), col(name))


def _breaks_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line of the file holds an odd number of quotes, so a cell goes on below."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def typed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose columns are doubles where every present cell is a number.

    Typing is decided by one aggregate over all columns, so that a single ``inf``
    does not turn a sensor into text.  A file is read in splits unless a quoted
    cell runs over several lines.  Text cells keep their white space.  A file whose
    name Spark would pass over is read through a copy.
    """
    path = visible(spark, path)
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=_breaks_lines(spark, path))
    text = raw.select(*[cell(c).alias(c) for c in raw.columns])
    bad = text.agg(*[
        F.count_if(col(c).isNotNull() & parsed(col(c)).isNull()).alias(f"_{i}")
        for i, c in enumerate(text.columns)
    ]).first()
    return text.select(*[
        (parsed(col(c)) if bad[f"_{i}"] == 0 else col(c)).alias(c)
        for i, c in enumerate(text.columns)
    ])


def without_infinities(df: DataFrame) -> DataFrame:
    """NaN and infinities of the numeric columns become NULL."""
    return df.select(*[
        finite(col(f.name)).alias(f.name) if is_numeric(f.dataType) else col(f.name)
        for f in df.schema.fields
    ])


def tidy_runs(df: DataFrame, path: str = "", drop_non_finite: bool = True) -> RunTable:
    """Infinities to NULL, incomplete rows counted and, if asked, dropped."""
    numeric = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    rows = without_infinities(df)
    bad = F.lit(False)
    for c in numeric:
        bad = bad | col(c).isNull()
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).first()
    dropped = got["bad"] if drop_non_finite else 0
    kept = rows.where(~bad) if dropped else rows
    return RunTable(kept, {"path": path, "rows_read": got["n"], "rows_dropped": dropped,
                           "rows_with_non_finite": got["bad"]})


def read_runs(spark: SparkSession, path: str, drop_non_finite: bool = True) -> RunTable:
    return tidy_runs(typed_csv(spark, path), path, drop_non_finite)


def read_nominal(spark: SparkSession, path: str, sensors: tuple[str, ...] = SENSOR_NAMES) -> DataFrame:
    """The fixed sensors of a nominal CSV, complete rows only."""
    df = typed_csv(spark, path).select(*[col(s) for s in sensors])
    return without_infinities(df).dropna()


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a failure CSV, rows complete in every column (label included)."""
    return without_infinities(typed_csv(spark, path)).dropna()
