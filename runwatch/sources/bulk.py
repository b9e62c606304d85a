"""Reading the files of many operating points together.

Files with the same header line are one signature and are read in one scan; which operating point
and side a row belongs to follows from the path of its file.  The number of Spark jobs grows with
the number of signatures, not with the number of files.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import FAILURE, finite, parsed
from ..operators.roles import INTENSITY_PATTERNS, LABEL_PATTERNS, MAX_LABELS, ColumnStats, matches
from ..runtime import attach, col, visible
from .tables import cell

FILE = "__file"


@dataclass
class FileFacts:
    """What the scans found out about one file; serves ``infer_roles`` as its measures."""

    path: str
    columns: list[str]
    numeric: set[str] = field(default_factory=set)
    rows: int = 0
    bad: int = 0
    kept: int = 0
    stats: dict[str, ColumnStats] = field(default_factory=dict)
    ratio: dict[str, float] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([
            T.StructField(c, T.DoubleType() if c in self.numeric else T.StringType()) for c in self.columns])

    def column_stats(self, numeric: list[str], distinct_of: list[str]) -> tuple[dict, int]:
        return {c: self.stats[c] for c in [*numeric, *distinct_of]}, self.kept

    def distinct_ratios(self, columns: list[str], n_rows: int) -> dict[str, float]:
        return {c: self.ratio[c] for c in columns}

    def info(self, dropped: bool) -> dict:
        return {"path": self.path, "rows_read": self.rows, "rows_dropped": self.bad if dropped else 0,
                "rows_with_non_finite": self.bad}


@dataclass
class Signature:
    """The files of one header: their text cells with the file's name, and the facts of each file."""

    cells: DataFrame
    columns: list[str]
    files: dict[str, FileFacts]

    def numeric(self, name: str, kinds: Column) -> Column:
        """Whether the column is one of numbers in the file of the row; a literal where all files agree."""
        said = {name in f.numeric for f in self.files.values()}
        return F.lit(said.pop()) if len(said) == 1 else F.array_contains(kinds, F.lit(name))

    def value(self, name: str, kinds: Column) -> Column:
        """The cell as a double: finite in a column of numbers, any number a text stands for elsewhere."""
        number = parsed(col(name))
        return F.when(self.numeric(name, kinds), finite(number)).otherwise(number)

    def text(self, name: str, kinds: Column) -> Column:
        return F.when(self.numeric(name, kinds), finite(parsed(col(name))).cast("string")).otherwise(col(name))

    def incomplete(self, kinds: Column) -> Column:
        """Whether some number of the row is missing or not finite."""
        ever = [c for c in self.columns if any(c in f.numeric for f in self.files.values())]
        return reduce(lambda a, b: a | b, [
            self.numeric(c, kinds) & finite(parsed(col(c))).isNull() for c in ever], F.lit(False))

    def tagged(self, rows: list[tuple], schema: str) -> DataFrame:
        """The cells next to a small table by file, ``(file, ...)``."""
        table = self.cells.sparkSession.createDataFrame(rows, f"{FILE} string, {schema}")
        return attach(self.cells, table, [FILE], rows=len(rows), row_bytes=64 * (len(self.columns) + 4))

    def kinds(self) -> list[tuple]:
        return [(name, sorted(f.numeric)) for name, f in self.files.items()]


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def _names(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The name under which Spark reports each path, so that rows find their source."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    out = {}
    for path in paths:
        place = hadoop.Path(path)
        full = place.getFileSystem(conf).makeQualified(place).toUri().toString()
        out[path] = "/" + full.removeprefix("file:").lstrip("/") if full.startswith("file:") else full
    return out


def signatures(spark: SparkSession, paths: list[str]) -> list[Signature]:
    """Group the files by their first line and by whether a quoted cell breaks a line, from one scan.

    A file without a first line raises ``ValueError``.
    """
    seen = {path: visible(spark, path) for path in dict.fromkeys(paths)}
    names = _names(spark, list(seen.values()))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = spark.read.text(list(seen.values())).select(
        _plain(F.col("_metadata.file_path")).alias(FILE), "value", (quotes % 2).alias("odd"),
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("place"))
    # lines of the first block of a file are numbered in their order; only one line a file leaves a task
    heads = {r[FILE]: (r["head"], r["breaks"]) for r in lines.groupBy(FILE).agg(
        F.min_by("value", "place").alias("head"), F.max("odd").alias("breaks")).collect()}
    groups = defaultdict(list)
    for path, place in seen.items():
        if names[place] not in heads:
            raise ValueError(f"{path} has no header line")
        head, breaks = heads[names[place]]
        # a header that goes on below its first line says too little to share a scan
        groups[head, breaks, path if head.count('"') % 2 else None].append(path)
    out = []
    for (_, breaks, _), members in groups.items():
        places = [seen[path] for path in members]
        first = spark.read.csv(places[0], header=True, inferSchema=False, multiLine=bool(breaks))
        raw = spark.read.schema(first.schema).csv(places, header=True, multiLine=bool(breaks))
        columns = first.columns
        cells = raw.select(_plain(F.col("_metadata.file_path")).alias(FILE), *[cell(c).alias(c) for c in columns])
        files = {names[seen[path]]: FileFacts(path, columns) for path in members}
        out.append(Signature(cells, columns, files))
    return out


def measure(found: Signature, drop_non_finite: bool, roles_of: set[str]) -> None:
    """Fill in the facts of every file: types, lost rows, and what the role rules ask of ``roles_of``.

    Three scans whatever the number of files, a fourth where an intensity lies near the
    continuity point; one row a file is returned by each.
    """
    columns = found.columns
    at = list(enumerate(columns))
    typed = found.cells.groupBy(FILE).agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(col(c).isNotNull() & parsed(col(c)).isNull()).alias(f"b{i}") for i, c in at]).collect()
    for facts in found.files.values():  # without rows nothing speaks against numbers
        facts.numeric = set(columns)
    for row in typed:
        found.files[row[FILE]].rows = row["n"]
        found.files[row[FILE]].numeric = {c for i, c in at if row[f"b{i}"] == 0}

    kinds = F.col("__kinds")
    rows = found.tagged(found.kinds(), "__kinds array<string>")
    bad = found.incomplete(kinds)
    kept = ~bad if drop_non_finite else F.lit(True)
    value = {c: F.when(kept, finite(parsed(col(c)))) for c in columns}
    # -0.0 and 0.0 are one value
    known = {c: F.when(kept, F.when(found.numeric(c, kinds), (finite(parsed(col(c))) + 0.0).cast("string"))
                       .otherwise(col(c))) for c in columns}
    aggs = [F.count_if(bad).alias("bad"), F.count_if(kept).alias("kept")]
    for i, c in at:
        aggs += [F.count(value[c]).alias(f"f{i}"), (F.min(value[c]) < F.max(value[c])).alias(f"v{i}"),
                 F.approx_count_distinct(known[c]).alias(f"d{i}")]
        if matches(c, INTENSITY_PATTERNS) or c in roles_of:
            aggs.append(F.approx_count_distinct(value[c], 0.02).alias(f"r{i}"))
    near, close = defaultdict(list), defaultdict(list)
    for row in rows.groupBy(FILE).agg(*aggs).collect():
        facts, got = found.files[row[FILE]], row.asDict()
        facts.bad, facts.kept = got["bad"], got["kept"]
        for i, c in at:
            facts.stats[c] = ColumnStats(got[f"d{i}"], got[f"f{i}"], bool(got[f"v{i}"]))
            asked = c not in facts.numeric or c in roles_of or matches(c, LABEL_PATTERNS)
            if asked and got[f"d{i}"] <= 1.5 * MAX_LABELS:
                near[row[FILE]].append(c)
            if f"r{i}" in got:
                facts.ratio[c] = got[f"r{i}"] / max(facts.kept, 1)
                if 0.4 < facts.ratio[c] < 0.6:  # too close for the sketch
                    close[row[FILE]].append(c)
    for facts in found.files.values():
        for c in columns:
            facts.stats.setdefault(c, ColumnStats(0, 0, False))
            facts.ratio.setdefault(c, 0.0)
    # sets of about 90 values at most, so no row is repeated for each column
    for name, c, n in _exact(found, rows, near, lambda c, here: F.size(F.collect_set(F.when(here, known[c])))):
        found.files[name].stats[c].distinct = n
    for name, c, n in _exact(found, rows, close, lambda c, here: F.count_distinct(F.when(here, value[c]))):
        found.files[name].ratio[c] = n / max(found.files[name].kept, 1)


def _exact(found: Signature, rows: DataFrame, wanted: dict[str, list[str]], count):
    """``(file, column, count)`` for the columns each file asks for, from one scan."""
    columns = sorted({c for asked in wanted.values() for c in asked})
    if not columns:
        return
    spark = rows.sparkSession
    table = spark.createDataFrame(list(wanted.items()), f"{FILE} string, __ask array<string>")
    asking = attach(rows, table, [FILE], rows=len(wanted), row_bytes=64 * (len(columns) + 1))
    got = asking.groupBy(FILE).agg(*[
        count(c, F.array_contains("__ask", F.lit(c))).alias(f"e{i}") for i, c in enumerate(columns)]).collect()
    for row in got:
        for i, c in enumerate(columns):
            if c in wanted[row[FILE]]:
                yield row[FILE], c, row[f"e{i}"]


def canonical(found: Signature, members: list[tuple], sensors: list[str], drop_non_finite: bool) -> DataFrame:
    """``run_id, op, set, class, intensity, <sensors>`` of all files of a signature in one scan.

    ``members`` are (file, operating point, side, its roles); ``sensors`` lists those of the whole
    dataset, NULL where the operating point of a row has none of that name.
    """
    kinds, side = F.col("__kinds"), F.col("__side")
    rows = found.tagged(
        [(name, sorted(found.files[name].numeric), op, s, roles.label, roles.intensity, list(roles.sensors))
         for name, op, s, roles in members],
        "__kinds array<string>, __op string, __side string, __label string, __intensity string, "
        "__sensors array<string>")
    if drop_non_finite:
        rows = rows.where(~found.incomplete(kinds))

    def of_role(role: str, named: set[str], make, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for name in sorted(named & set(found.columns)):
            out = F.when((side == FAILURE) & (F.col(role) == F.lit(name)), make(name, kinds)).otherwise(out)
        return out

    def sensor(name: str) -> Column:
        offered = [name in roles.sensors for *_, roles in members]
        if name not in found.columns or not any(offered):
            return F.lit(None).cast("double")
        value = found.value(name, kinds)
        return value if all(offered) else F.when(F.array_contains("__sensors", F.lit(name)), value)

    if "run_id" in found.columns:
        run_id = found.text("run_id", kinds)
    else:  # stored right after, so the number stays with the run
        run_id = F.concat("__op", F.lit("-"), side, F.lit("-"), F.monotonically_increasing_id())
    labels = {roles.label for *_, roles in members} - {None}
    swept = {roles.intensity for *_, roles in members} - {None}
    return rows.select(
        run_id.alias("run_id"), F.col("__op").alias("op"), side.alias("set"),
        of_role("__label", labels, found.text, "string").alias("class"),
        of_role("__intensity", swept, found.value, "double").alias("intensity"),
        *[sensor(s).alias(s) for s in sensors])
