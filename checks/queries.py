"""Every registered query with its DuckDB twin (``None``: rows only).

All of them read whole driver tables.  Row-level results are rounded to fewer
digits than aggregates, so that summation order cannot show.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runwatch import Dataset, Mahalanobis, ModelBank, pod_analysis, score_frame
from runwatch.operators import binning, detectability, ordering, prepare, quality, views
from runwatch.operators import roles as role_ops
from runwatch.operators import select as sel
from runwatch.plans.bank import detectability_summary
from runwatch.sources import catalog, dataset, tables as source_tables

from . import sql as Q
from .sql import r, runs_cte, scored
from .tables import (
    DIRTY, EVENTS, FAILURE_FRAME, NOMINAL_FRAME, PATHS, RUNS, S4, S7, duck, embeddings, runs,
    spark_view,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

EMPIRICAL = Mahalanobis(cov="empirical", threshold="empirical", alpha=0.01)
DEFAULT = Mahalanobis(threshold="empirical", alpha=0.01)
IN_SAMPLE = Mahalanobis(cov="empirical", threshold="chi2", alpha=0.01, calib_fraction=0.0)


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def rd(c, digits: int):
    """Rounded, with no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def nominal(spark, d):
    return sel.nominal_runs(runs(spark, d))


def model(spark, d, template=DEFAULT, sensors=S7):
    return template.fit(nominal(spark, d), sensors)


def fitted_scores(spark, d, template=DEFAULT):
    return ModelBank(model(spark, d, template)).score_dataset(runs(spark, d))


# -- runs, classes, intensity ---------------------------------------------------------------

@query("class_counts", f"WITH {runs_cte()} SELECT op, class, count(*) AS n FROM runs "
       "WHERE side = 'failure' GROUP BY op, class")
def _(spark, d):
    return sel.class_counts(runs(spark, d))


@query("class_names", f"WITH {runs_cte()} SELECT DISTINCT op, class FROM runs WHERE class IS NOT NULL")
def _(spark, d):
    return sel.class_names(runs(spark, d))


@query("describe_intensity", f"""WITH {runs_cte()}, m AS (SELECT op, class, count(*) AS n,
  min(intensity) AS lo, max(intensity) AS hi, max(abs(intensity)) AS a,
  count(DISTINCT intensity) AS u FROM runs WHERE side = 'failure' GROUP BY op, class)
SELECT op, class, n, {r('lo', 6)} AS min, {r('hi', 6)} AS max, {r('a', 6)} AS abs_max,
  u AS n_unique, CASE WHEN lo >= 0 AND hi >= 20 AND hi <= 100 THEN 'percent'
  WHEN hi > 100 OR lo < -100 THEN 'absolute' WHEN lo >= 0 AND hi <= 1 THEN 'percent'
  ELSE 'unknown' END AS mode_guess FROM m""")
def _(spark, d):
    t = sel.describe_intensity(sel.failure_runs(runs(spark, d)))
    return t.withColumns({c: rd(c, 6) for c in ("min", "max", "abs_max")})


@query("failures_of_class", f"WITH {runs_cte()} SELECT run_id, op, {r('intensity', 6)} AS intensity, "
       f"{r('s1', 6)} AS s1 FROM runs WHERE class = 'R'")
def _(spark, d):
    rows = sel.failure_runs(runs(spark, d), ["R"])
    return rows.select("run_id", "op", rd(sel.signed_intensity(rows), 6).alias("intensity"),
                       rd("s1", 6).alias("s1"))


@query("numeric_columns", f"""WITH {runs_cte(DIRTY)} SELECT TRY_CAST(text AS DOUBLE) AS text,
  CASE WHEN isfinite(s3) THEN s3 END AS s3 FROM runs""")
def _(spark, d):
    return sel.select_numeric(spark_view(spark, d, DIRTY), ["text", "s3"])


@query("dataset_summary", f"""WITH {runs_cte()} SELECT op,
  count(*) FILTER (WHERE side = 'nominal') AS nominal,
  count(*) FILTER (WHERE side = 'failure') AS failures,
  count(DISTINCT class) AS classes, CAST({len(S7)} AS BIGINT) AS sensors FROM runs GROUP BY op""")
def _(spark, d):
    return Dataset.from_runs(runs(spark, d), S7).summary()


def _roles_by_op(spark, d) -> DataFrame:
    """Per operating point, the sensors that carry any value there."""
    rows = runs(spark, d)
    rows = rows.withColumn("s4", F.when(F.col("op") == "F", F.col("s4")))
    wide = rows.groupBy("op").agg(*[F.count(s).alias(s) for s in S7])
    cells = F.array(*[F.struct(F.lit(s).alias("column"), F.lit(j).alias("position"),
                               F.col(s).alias("c")) for j, s in enumerate(S7)])
    long = wide.select("op", F.inline(cells)).where("c > 0")
    return long.select("op", "column", F.lit("sensor").alias("role"), "position")


@query("sensor_availability", f"""WITH {runs_cte()}, o AS (
  {" UNION ALL ".join(f"SELECT '{s}' AS sensor, op, count({s if s != 's4' else "CASE WHEN op = 'F' THEN s4 END"}) > 0 AS has FROM runs GROUP BY op" for s in S7)})
SELECT sensor, bool_or(has AND op = 'F') AS "F", bool_or(has AND op = 'O') AS "O" FROM o GROUP BY sensor""")
def _(spark, d):
    return dataset.sensor_availability(_roles_by_op(spark, d), ["F", "O"])


@query("common_sensors", f"""WITH {runs_cte()}, o AS (
  {" UNION ALL ".join(f"SELECT '{s}' AS sensor, op FROM runs GROUP BY op HAVING count({s if s != 's4' else "CASE WHEN op = 'F' THEN s4 END"}) > 0" for s in S7)})
SELECT sensor FROM o GROUP BY sensor HAVING count(*) = (SELECT count(DISTINCT op) FROM runs)""")
def _(spark, d):
    return dataset.common_sensors(_roles_by_op(spark, d))


@query("unknown_operating_points", f"""WITH {runs_cte()} SELECT DISTINCT op FROM runs
  WHERE op NOT IN (SELECT op FROM runs WHERE side = 'nominal' AND s4 > 9e0)""")
def _(spark, d):
    rows = runs(spark, d)
    known = sel.nominal_runs(rows).where("s4 > 9").select("op").distinct()
    return rows.select("op").distinct().join(known, "op", "left_anti")


# -- sources --------------------------------------------------------------------------------

_DIRTY_NUM = ["s1", "s2", "s3", "s_const", "intensity"]


@query("load_counts", f"""WITH {runs_cte(DIRTY)}, b AS (SELECT NOT (coalesce(isfinite(s1), FALSE)
  AND coalesce(isfinite(s2), FALSE) AND isfinite(s3)) AS bad FROM runs)
SELECT count(*) AS rows_read, count(*) FILTER (WHERE bad) AS rows_dropped,
  count(*) FILTER (WHERE bad) AS rows_with_non_finite FROM b""")
def _(spark, d):
    info = source_tables.tidy_runs(spark_view(spark, d, DIRTY).drop("intensity")).info
    rows = [(info["rows_read"], info["rows_dropped"], info["rows_with_non_finite"])]
    return spark.createDataFrame(
        rows, "rows_read bigint, rows_dropped bigint, rows_with_non_finite bigint")


@query("clean_runs", f"""WITH {runs_cte(DIRTY)} SELECT run_id, {r('s1', 6)} AS s1, {r('s2', 6)} AS s2
  FROM runs WHERE isfinite(s1) AND isfinite(s2)""")
def _(spark, d):
    rows = source_tables.tidy_runs(spark_view(spark, d, DIRTY).drop("intensity")).df
    return rows.select("run_id", rd("s1", 6).alias("s1"), rd("s2", 6).alias("s2"))


_TOK = "list_filter(regexp_split_to_array(stem, '[^A-Za-z0-9]+'), lambda t: t <> '')"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_NOM, _FAIL = _LIST(catalog.NOMINAL_TOKENS), _LIST(catalog.FAILURE_TOKENS)
_FILES = f"""paths AS ({duck(PATHS)}),
stems AS (SELECT path, substr(path, 7) AS rel, regexp_extract(substr(path, 7), '^(.*)/[^/]*$', 1) AS dir,
  regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[.][^.]*$', '') AS stem FROM paths),
toks AS (SELECT *, {_TOK} AS tokens, list_transform({_TOK}, lambda t: lower(t)) AS low FROM stems),
tell AS (SELECT *, list_filter(low, lambda t: regexp_matches(t, 'failure|fault|guast|nominal'))[1] AS f FROM toks),
kinds AS (SELECT *, CASE WHEN list_has_any(low, {_FAIL}) THEN 'failures'
  WHEN list_has_any(low, {_NOM}) THEN 'nominal'
  WHEN regexp_matches(f, 'failure|fault|guast') THEN 'failures' WHEN f IS NOT NULL THEN 'nominal' END AS kind FROM tell),
keyed AS (SELECT *, array_to_string(list_filter(tokens, lambda t: NOT list_contains(
  list_concat(CASE WHEN kind = 'nominal' THEN {_NOM} ELSE {_FAIL} END, ['table', 'data', 'csv']), lower(t))), '_') AS key
  FROM kinds)"""


@query("catalog_files", f"WITH {_FILES} SELECT path, dir, kind, key FROM keyed")
def _(spark, d):
    files = catalog.describe_paths(spark_view(spark, d, PATHS), "/lake")
    return files.select("path", "dir", "kind", "key")


_SHARED = _LIST(catalog.NOMINAL_TOKENS + catalog.FAILURE_TOKENS + catalog.IGNORED_TOKENS)


@query("catalog_pairs", f"""WITH {_FILES}, per_dir AS (SELECT dir, count(*) FILTER (WHERE kind = 'nominal') AS nn,
  count(*) FILTER (WHERE kind = 'failures') AS nf FROM keyed GROUP BY dir),
slots AS (SELECT keyed.*, nn = 1 AND nf = 1 AS alone,
  CASE WHEN nn = 1 AND nf = 1 THEN '' ELSE key END AS slot FROM keyed JOIN per_dir USING (dir)),
latest AS (SELECT dir, slot, alone, kind, max(rel) AS rel FROM slots WHERE kind IS NOT NULL GROUP BY ALL),
n AS (SELECT dir, slot, alone, rel AS nominal FROM latest WHERE kind = 'nominal'),
f AS (SELECT dir, slot, alone, rel AS failures FROM latest WHERE kind = 'failures'),
both_ AS (SELECT dir, slot, alone, nominal, failures FROM n FULL OUTER JOIN f USING (dir, slot, alone)),
named AS (SELECT *, CASE WHEN nominal IS NULL OR failures IS NULL THEN NULL
  WHEN alone THEN replace(dir, '/', '_') ELSE coalesce(nullif(slot, ''), regexp_extract(dir, '([^/]*)$', 1)) END AS name
  FROM both_),
turns AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY dir, slot) AS turn FROM named)
SELECT CASE WHEN name IS NOT NULL AND turn > 1 THEN name || '_' || turn ELSE name END AS name,
  dir, slot AS key, nominal, failures,
  CASE WHEN name IS NULL THEN 'half' ELSE 'paired' END AS status FROM turns
UNION ALL SELECT NULL, dir, key, CASE WHEN kind = 'nominal' THEN rel END,
  CASE WHEN kind = 'failures' THEN rel END, 'replaced' FROM slots
  WHERE kind IS NOT NULL AND rel NOT IN (SELECT rel FROM latest)
UNION ALL SELECT NULL, dir, key, NULL, rel, 'unknown' FROM slots WHERE kind IS NULL""")
def _(spark, d):
    return catalog.pair_files(spark_view(spark, d, PATHS), "/lake")


# -- column roles -----------------------------------------------------------------------------

def _frames(spark, d):
    return spark_view(spark, d, FAILURE_FRAME), spark_view(spark, d, NOMINAL_FRAME)


_ROLE_COLS = ["Failure", "Intensity", "run_id", "s1", "s2", "s3", "s4", "s_const", "status"]
_FRAME_CTE = f"ff AS ({duck(FAILURE_FRAME)})"
_LABEL_RX, _INT_RX = "|".join(role_ops.LABEL_PATTERNS), "|".join(role_ops.INTENSITY_PATTERNS)


@query("label_candidates", f"""WITH {_FRAME_CTE}, c AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS name, count(DISTINCT {c}) AS u, {'TRUE' if c in ('Failure', 'run_id', 'status') else 'FALSE'} AS txt, {'TRUE' if c in ('Failure', 'Intensity') else 'FALSE'} AS extra FROM ff"
    for c in _ROLE_COLS)}),
s AS (SELECT name, u, CASE WHEN txt THEN 3e0 ELSE 0e0 END
  + CASE WHEN regexp_matches(lower(name), '{_LABEL_RX}') THEN 3e0 ELSE 0e0 END
  + CASE WHEN extra THEN 2e0 ELSE 0e0 END + CASE WHEN u <= 40 THEN 1e0 ELSE 0e0 END AS score
  FROM c WHERE u BETWEEN 2 AND 60)
SELECT name AS candidate, score, u AS distinct_values,
  row_number() OVER (ORDER BY score DESC, u, name DESC) AS place FROM s WHERE score >= 3e0""")
def _(spark, d):
    failures, nom = _frames(spark, d)
    numeric = [c for c in failures.columns if role_ops.is_numeric(failures.schema[c].dataType)]
    extra = {c for c in failures.columns if c not in nom.columns}
    stats, _n = role_ops.column_stats(failures, numeric, failures.columns)
    found = role_ops.label_candidates(
        failures.columns, set(failures.columns) - set(numeric), extra, stats)
    rows = [(c, s, u, i + 1) for i, (c, s, u) in enumerate(found)]
    return spark.createDataFrame(
        rows, "candidate string, score double, distinct_values bigint, place bigint")


@query("intensity_candidates", f"""WITH {_FRAME_CTE}, c AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS name, count(DISTINCT {c})/CAST(count(*) AS DOUBLE) AS ratio, min({c}) < max({c}) AS varies, {'TRUE' if c == 'Intensity' else 'FALSE'} AS extra FROM ff"
    for c in _ROLE_COLS if c not in ("Failure", "run_id", "status"))}),
s AS (SELECT name, CASE WHEN regexp_matches(lower(name), '{_INT_RX}') THEN 4e0 ELSE 0e0 END
  + CASE WHEN extra THEN 3e0 ELSE 0e0 END + CASE WHEN ratio > 0.5e0 THEN 1e0 ELSE 0e0 END AS score
  FROM c WHERE varies)
SELECT name AS candidate, score, row_number() OVER (ORDER BY score DESC, name) AS place
FROM s WHERE score >= 3e0""")
def _(spark, d):
    failures, nom = _frames(spark, d)
    numeric = [c for c in failures.columns if role_ops.is_numeric(failures.schema[c].dataType)]
    extra = {c for c in failures.columns if c not in nom.columns}
    stats, n = role_ops.column_stats(failures, numeric, [])
    found = role_ops.intensity_candidates(
        numeric, extra, "Failure", stats, n, role_ops.TableFacts(failures).distinct_ratios)
    rows = [(c, s, i + 1) for i, (c, s) in enumerate(found)]
    return spark.createDataFrame(rows, "candidate string, score double, place bigint")


@query("roles_table", f"""WITH {_FRAME_CTE}, c AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS name, {i} AS pos, count(DISTINCT {c}) AS u, {'TRUE' if c in ('Failure', 'run_id', 'status') else 'FALSE'} AS txt FROM ff"
    for i, c in enumerate(_ROLE_COLS))}),
g AS (SELECT name, pos, CASE WHEN name = 'Failure' THEN 'label' WHEN name = 'Intensity' THEN 'intensity'
  WHEN txt THEN 'meta' WHEN u = 1 THEN 'excluded' ELSE 'sensor' END AS role FROM c)
SELECT 'LI' AS op, name AS "column", role, CAST(row_number() OVER (ORDER BY
  list_position(['sensor', 'label', 'intensity', 'meta', 'excluded'], role), pos) - 1 AS INT) AS position FROM g""")
def _(spark, d):
    return role_ops.roles_frame(spark, {"LI": role_ops.infer_roles(*_frames(spark, d))})


# -- quality ------------------------------------------------------------------------------------

_DS = ["s1", "s2", "s3", "s_const"]


@query("missing_counts", f"""WITH {runs_cte(DIRTY)}, m AS ({" UNION ALL ".join(
    f"SELECT op, '{s}' AS sensor, count(*) FILTER (WHERE {s} IS NULL OR isnan({s})) AS missing, "
    f"count(*) FILTER (WHERE {s} IS NULL OR NOT isfinite({s})) AS non_finite, "
    f"min({s}) FILTER (WHERE isfinite({s})) >= max({s}) FILTER (WHERE isfinite({s})) AS constant "
    f"FROM runs GROUP BY op" for s in _DS)})
SELECT op, sensor, missing, non_finite, constant FROM m WHERE missing > 0 OR non_finite > 0 OR constant""")
def _(spark, d):
    t = quality.sensor_counts(spark_view(spark, d, DIRTY), ["op"], _DS)
    hit = (F.col("missing") > 0) | (F.col("non_finite") > 0) | F.col("constant")
    return t.where(hit).drop("position")


@query("duplicate_rows", f"""WITH {runs_cte(DIRTY)}, c AS (SELECT op,
  CASE WHEN isnan(s1) THEN NULL ELSE s1 END AS a, s3, count(*) AS c FROM runs GROUP BY 1, 2, 3)
SELECT op, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows FROM c GROUP BY op""")
def _(spark, d):
    return quality.duplicate_rows(spark_view(spark, d, DIRTY), ["op"], ["s1", "s3"])


_LIVE = [s for s in S7 if s != "s_const"]


@query("correlation_pairs", f"""WITH {runs_cte()}, p AS ({" UNION ALL ".join(
    f"SELECT op, '{a}' AS a, '{b}' AS b, {Q.pair_corr(a, b)} AS r FROM runs WHERE side = 'nominal' GROUP BY op"
    for i, a in enumerate(_LIVE) for b in _LIVE[i + 1:])})
SELECT op, CASE WHEN abs(r) >= 1 - 1e-9 THEN 'duplicate' WHEN abs(r) >= 0.999 THEN 'collinear' ELSE 'strong' END AS kind,
  a, b, {r('r', 9)} AS r FROM p WHERE abs(r) >= 0.98""")
def _(spark, d):
    q = quality.check(nominal(spark, d), ["op"], S7)
    return q.pairs.withColumn("r", rd("r", 9))


@query("correlation_cells", f"""WITH {runs_cte()} {" UNION ALL ".join(
    f"SELECT op, '{a}' AS a, '{b}' AS b, " + ("1e0" if a == b else r(f"coalesce({Q.pair_corr(a, b)}, 0e0)", 6))
    + f" AS r, {'TRUE' if False else 'FALSE'} OR ({i} < {j} AND abs(coalesce({Q.pair_corr(a, b)}, 0e0)) >= 0.98e0) AS marked FROM runs WHERE side = 'nominal' GROUP BY op"
    for i, a in enumerate(S7) for j, b in enumerate(S7))}""")
def _(spark, d):
    cells = quality.correlation_cells(nominal(spark, d), ["op"], S7)
    return cells.select("op", "a", "b", rd("r", 6).alias("r"), "marked")


@query("quality_report")
def _(spark, d):
    t = quality.check(runs(spark, d), ["op", "set"], S7).summary
    return t.drop("eigenvalues").withColumns({"samples_per_sensor": rd("samples_per_sensor", 6)})


@query("eigen_spectrum")
def _(spark, d):
    t = quality.check(nominal(spark, d), ["op"], S7).spectrum()
    return t.select("op", "component", rd("eigenvalue", 6).alias("eigenvalue"), "effective_rank")


@query("quality_counts", f"""WITH {runs_cte()}, g AS (SELECT op, side, {", ".join(S7)}, count(*) AS copies FROM runs
  GROUP BY ALL), d AS (SELECT op, side, CAST(sum(copies - 1) AS BIGINT) AS duplicate_rows FROM g GROUP BY op, side),
c AS (SELECT op, side, count(*) AS n_rows, {", ".join(f"min({s}) = max({s}) AS k_{s}" for s in S7)},
  abs({Q.pair_corr('s1', 's1_dup')}) AS r1, abs({Q.pair_corr('s2', 's2_near')}) AS r2 FROM runs GROUP BY op, side)
SELECT op, side AS set, n_rows, 7 AS n_sensors, {r('n_rows / 7e0', 6)} AS samples_per_sensor,
  CAST(0 AS BIGINT) AS rows_non_finite, CAST(0 AS BIGINT) AS values_non_finite, duplicate_rows,
  concat_ws(',', {", ".join(f"CASE WHEN k_{s} THEN '{s}' END" for s in S7)}) AS constant,
  concat_ws(',', CASE WHEN r1 >= 0.999e0 THEN 's1_dup' END, CASE WHEN r2 >= 0.999e0 THEN 's2_near' END) AS redundant
FROM c JOIN d USING (op, side)""")
def _(spark, d):
    t = quality.check(runs(spark, d), ["op", "set"], S7).summary
    return t.select("op", "set", "n_rows", "n_sensors", rd("samples_per_sensor", 6).alias("samples_per_sensor"),
                    "rows_non_finite", "values_non_finite", "duplicate_rows",
                    F.array_join("constant", ",").alias("constant"), F.array_join("redundant", ",").alias("redundant"))


# the eigenvalues of a matrix add up to its trace, their squares to the squares of its cells
_SQUARES = " + ".join(
    f"2e0 * pow({Q.pair_corr(a, b)}, 2)" for i, a in enumerate(_LIVE) for b in _LIVE[i + 1:])


@query("spectrum_moments", f"""WITH {runs_cte()}, m AS (SELECT op, {len(_LIVE)}e0 AS trace,
  {len(_LIVE)}e0 + {_SQUARES} AS squares FROM runs WHERE side = 'nominal' GROUP BY op)
SELECT op, CAST({len(_LIVE)} AS BIGINT) AS components, {r('trace', 6)} AS trace, {r('squares', 5)} AS squares FROM m""")
def _(spark, d):
    t = quality.check(nominal(spark, d), ["op"], S7).spectrum()
    return t.groupBy("op").agg(
        F.count("*").alias("components"), rd(F.sum("eigenvalue"), 6).alias("trace"),
        rd(F.sum(F.col("eigenvalue") * F.col("eigenvalue")), 5).alias("squares"))


@query("largest_intensities", f"""WITH {runs_cte()}, t AS (SELECT op, class, run_id, abs(intensity) AS x,
  row_number() OVER (PARTITION BY op, class ORDER BY abs(intensity) DESC, run_id) AS place
  FROM runs WHERE side = 'failure' AND intensity IS NOT NULL AND class IS NOT NULL)
SELECT op, class, CAST(place AS INT) AS place, run_id, {r('x', 6)} AS intensity FROM t WHERE place <= 5""")
def _(spark, d):
    return sel.largest_intensities(runs(spark, d), 5).withColumn("intensity", rd("intensity", 6))


# -- preparation ----------------------------------------------------------------------------------

@query("scaler_table", f"""WITH {runs_cte()} {" UNION ALL ".join(
    f"SELECT op, '{s}' AS sensor, {j} AS position, {r(f'avg({s})', 6)} AS center, {r(f'CASE WHEN min({s}) < max({s}) THEN stddev_pop({s}) ELSE 1e0 END', 6)} AS scale FROM runs WHERE side = 'nominal' GROUP BY op"
    for j, s in enumerate(S7))}""")
def _(spark, d):
    t = prepare.scaler_table(prepare.fit_scaler(nominal(spark, d), ["op"], S7), ["op"], S7)
    return t.withColumns({"center": rd("center", 6), "scale": rd("scale", 6)})


@query("robust_scaler", f"""WITH {runs_cte()}, n AS (SELECT * FROM runs WHERE side = 'nominal'),
m AS (SELECT op, {", ".join(f"median({s}) AS m_{s}" for s in S7)} FROM n GROUP BY op) {" UNION ALL ".join(
    f"SELECT op, '{s}' AS sensor, {j} AS position, {r(f'any_value(m_{s})', 6)} AS center, {r(f'coalesce(nullif(1.4826e0 * median(abs({s} - m_{s})), 0e0), 1e0)', 6)} AS scale FROM n JOIN m USING (op) GROUP BY op"
    for j, s in enumerate(S7))}""")
def _(spark, d):
    s = prepare.fit_scaler(nominal(spark, d), ["op"], S7, "robust")
    t = prepare.scaler_table(s, ["op"], S7)
    return t.withColumns({"center": rd("center", 6), "scale": rd("scale", 6)})


_SC = f"sc AS (SELECT op, {', '.join(f'avg({s}) AS c_{s}, stddev_pop({s}) AS t_{s}' for s in S4)} FROM runs WHERE side = 'nominal' GROUP BY op)"


@query("standardize", f"""WITH {runs_cte()}, {_SC} SELECT run_id, op,
  {", ".join(r(f'({s} - c_{s})/t_{s}', 4) + f' AS {s}' for s in S4)} FROM runs JOIN sc USING (op)""")
def _(spark, d):
    s = prepare.fit_scaler(nominal(spark, d), ["op"], S4)
    z = prepare.scale(runs(spark, d), s, ["op"], S4)
    return z.select("run_id", "op", *[rd(c, 4).alias(c) for c in S4])


@query("unscale", f"WITH {runs_cte()} SELECT run_id, op, "
       + ", ".join(r(s, 3) + f" AS {s}" for s in S4) + " FROM runs")
def _(spark, d):
    s = prepare.fit_scaler(nominal(spark, d), ["op"], S4)
    z = prepare.scale(runs(spark, d), s, ["op"], S4)
    back = prepare.unscale(z, s, ["op"], S4)
    return back.select("run_id", "op", *[rd(c, 3).alias(c) for c in S4])


_GREEDY, _GREEDY_ROWS = Q.greedy_cte()


@query("drop_redundant", f"WITH {runs_cte()}, {_GREEDY} {_GREEDY_ROWS}")
def _(spark, d):
    return prepare.redundancy_table(
        prepare.drop_redundant(nominal(spark, d), ["op"], S7), ["op"], S7)


def _u(tag: str) -> str:
    return (f"((CAST('0x' || substr(md5(run_id || '#{tag}'), 1, 13) AS BIGINT) + 0.5e0) / "
            f"{float(2**52)!r})")


@query("add_noise", f"""WITH {runs_cte()}, w AS (SELECT op, stddev_pop(s1) AS w1, stddev_pop(s3) AS w3
  FROM runs GROUP BY op) SELECT run_id, op, {", ".join(
    r(f"{s} + 0.1e0 * w{s[1]} * sqrt(-2e0 * ln({_u(f'5#{s}#r')})) * cos({2 * 3.141592653589793!r} * {_u(f'5#{s}#a')})", 4) + f' AS {s}'
    for s in ('s1', 's3'))} FROM runs JOIN w USING (op)""")
def _(spark, d):
    t = prepare.add_noise(runs(spark, d), ["op"], ["s1", "s3"], 0.1, seed=5)
    return t.select("run_id", "op", rd("s1", 4).alias("s1"), rd("s3", 4).alias("s3"))


@query("split", f"""WITH {runs_cte()}, k AS (SELECT run_id, op, row_number() OVER (PARTITION BY op
  ORDER BY md5(run_id || '#3'), run_id) AS rk, count(*) OVER (PARTITION BY op) AS n
  FROM runs WHERE side = 'nominal')
SELECT run_id, op, rk <= round_even(0.3e0 * n, 0) AS is_test FROM k""")
def _(spark, d):
    return ordering.split(nominal(spark, d), ["op"], seed=3).select("run_id", "op", "is_test")


@query("stratified_split", f"""WITH {runs_cte()}, f AS (SELECT *, row_number() OVER (PARTITION BY op, class
  ORDER BY abs(intensity), md5(run_id || '#4'), run_id) AS rk, count(*) OVER (PARTITION BY op, class) AS n
  FROM runs WHERE side = 'failure'),
b AS (SELECT *, class || '|' || CAST(greatest(0, ((rk - 1) * least(5, n) + n - 2) // greatest(n - 1, 1) - 1) AS BIGINT) AS stratum FROM f),
s AS (SELECT *, row_number() OVER (PARTITION BY op, stratum ORDER BY md5(run_id || '#4'), run_id) AS k,
  count(*) OVER (PARTITION BY op, stratum) AS m FROM b)
SELECT run_id, op, stratum, m > 1 AND k <= least(round_even(0.3e0 * m, 0), m - 1) AS is_test FROM s""")
def _(spark, d):
    t = ordering.stratified_split(sel.failure_runs(runs(spark, d)), ["op"], seed=4)
    return t.select("run_id", "op", "stratum", "is_test")


@query("subsample", f"""WITH {runs_cte()}, k AS (SELECT run_id, op, side, row_number() OVER (
  PARTITION BY op, side ORDER BY md5(run_id || '#0'), run_id) AS rk FROM runs)
SELECT run_id, op, side AS "set" FROM k WHERE rk <= 4000""")
def _(spark, d):
    return ordering.subsample(runs(spark, d), ["op", "set"]).select("run_id", "op", "set")


# -- detector ---------------------------------------------------------------------------------------

_CLASS = "CASE WHEN side = 'nominal' THEN 'NOMINAL' ELSE class END"
_SCORES = (f"SELECT run_id, op, side AS \"set\", {_CLASS} AS class, {r('intensity', 4)} AS intensity, "
           f"{r('score', 4)} AS score, flagged FROM scored")


def _score_rows(t: DataFrame) -> DataFrame:
    return t.select("run_id", "op", "set", "class", rd("intensity", 4).alias("intensity"),
                    rd("score", 4).alias("score"), "flagged")


@query("score_dataset", scored("ledoit_wolf") + _SCORES)
def _(spark, d):
    return _score_rows(fitted_scores(spark, d))


@query("score_empirical", scored("empirical", calib=0.0, rule="chi2") + _SCORES)
def _(spark, d):
    return _score_rows(fitted_scores(spark, d, IN_SAMPLE))


@query("score_diagonal", scored("diagonal", calib=0.0, rule="chi2") + _SCORES)
def _(spark, d):
    template = Mahalanobis(cov="diagonal", threshold="chi2", alpha=0.01, calib_fraction=0.0)
    return _score_rows(fitted_scores(spark, d, template))


@query("score_oas", scored("oas") + f"""SELECT op, side AS "set", count(*) AS n, {r('avg(score)', 6)} AS mean,
  {r('max(score)', 6)} AS max, count(*) FILTER (WHERE flagged) AS flagged FROM scored GROUP BY op, side""")
def _(spark, d):
    t = fitted_scores(spark, d, Mahalanobis(cov="oas", alpha=0.01))
    return t.groupBy("op", "set").agg(
        F.count(F.lit(1)).alias("n"), rd(F.avg("score"), 6).alias("mean"),
        rd(F.max("score"), 6).alias("max"), F.count_if("flagged").alias("flagged"))


_EV = ["v", "lv", "u"]


@query("score_events", f"""WITH {runs_cte(EVENTS)}, {Q.fit_cte('ledoit_wolf', sensors=_EV)}
  SELECT run_id, class, {r('score', 4)} AS score, flagged FROM scored WHERE side = 'failure'""")
def _(spark, d):
    rows = spark_view(spark, d, EVENTS)
    m = DEFAULT.fit(sel.nominal_runs(rows), _EV)
    return m.predict(sel.failure_runs(rows)).select(
        "run_id", "class", rd("score", 4).alias("score"), "flagged")


@query("empirical_threshold", scored("ledoit_wolf") + f"SELECT op, {r('thr', 6)} AS threshold FROM limits")
def _(spark, d):
    return model(spark, d).table.select("op", rd("threshold", 6).alias("threshold"))


@query("training_percentile", scored("ledoit_wolf", calib=0.0, rule="empirical")
       + f"SELECT op, {r('thr', 6)} AS threshold FROM limits")
def _(spark, d):
    m = model(spark, d, Mahalanobis(calib_fraction=0.0, threshold="chi2"))
    m = m.calibrate(nominal(spark, d), 0.01, "percentile")
    return m.table.select("op", rd("threshold", 6).alias("threshold"))


@query("threshold_table", scored("ledoit_wolf") + f"""SELECT op, 'chi2' AS rule,
  {r('sqrt(13.276704135987622)', 6)} AS threshold, FALSE AS selected FROM limits
  UNION ALL SELECT op, 'empirical', {r('thr', 6)}, TRUE FROM limits""")
def _(spark, d):
    t = model(spark, d).threshold_table().where("rule <> 'hotelling'")
    return t.select("op", "rule", rd("threshold", 6).alias("threshold"), "selected")


@query("model_parameters", scored("ledoit_wolf") + "SELECT op, CAST(n AS BIGINT) AS n_train, "
       + ", ".join(f"{r(f'c{i}', 5)} AS center_{i}, {r(f't{i}', 5)} AS scale_{i}" for i in Q.J)
       + ", " + ", ".join(f"{r(f'1e0/l{i}{i}', 6)} AS a_{i}" for i in Q.J) + " FROM models")
def _(spark, d):
    t = model(spark, d).table
    return t.select(
        "op", "diagnostics.n_train",
        *[rd(F.col("center")[i - 1], 5).alias(f"center_{i}") for i in Q.J],
        *[rd(F.col("scale")[i - 1], 5).alias(f"scale_{i}") for i in Q.J],
        *[rd(F.col("a")[i - 1][i - 1], 6).alias(f"a_{i}") for i in Q.J])


# Sigma^-1 delta by back substitution from y; contribution j is delta_j times it
_BACK = ", ".join(
    f"(y{i}" + "".join(f" - l{k}{i}*g{k}" for k in range(i + 1, 5)) + f")/l{i}{i} AS g{i}"
    for i in (4, 3, 2, 1))
_PARTS = scored("ledoit_wolf") + f", back AS (SELECT *, {_BACK} FROM scored)"
_PARTS_LONG = _PARTS + ", parts AS (" + " UNION ALL ".join(
    f"SELECT run_id, op, side, class, score, thr, d2, '{s}' AS sensor, {i} AS ord, dl{i}*g{i} AS contribution FROM back"
    for i, s in zip(Q.J, S4)) + ") "


@query("contributions", _PARTS_LONG + f"SELECT run_id, sensor, {r('contribution', 3)} AS contribution, "
       f"{r('contribution/d2', 3)} AS share FROM parts WHERE side = 'failure'")
def _(spark, d):
    t = model(spark, d).contribution_rows(sel.failure_runs(runs(spark, d)))
    return t.select("run_id", "sensor", rd("contribution", 3).alias("contribution"),
                    rd("share", 3).alias("share"))


@query("top_contributors", _PARTS_LONG + f""", o AS (SELECT *, row_number() OVER (PARTITION BY run_id
  ORDER BY contribution DESC, ord) AS place FROM parts WHERE side = 'failure')
SELECT run_id, any_value(sensor) FILTER (WHERE place = 1) AS sensor_1,
  {r('max(contribution/d2) FILTER (WHERE place = 1)', 3)} AS share_1,
  any_value(sensor) FILTER (WHERE place = 2) AS sensor_2,
  {r('max(contribution/d2) FILTER (WHERE place = 2)', 3)} AS share_2 FROM o GROUP BY run_id""")
def _(spark, d):
    t = model(spark, d).top_contributors(sel.failure_runs(runs(spark, d)), 2)
    return t.select("run_id", "sensor_1", rd("share_1", 3).alias("share_1"),
                    "sensor_2", rd("share_2", 3).alias("share_2"))


@query("contribution_shares", _PARTS_LONG + f""", m AS (SELECT op, class, sensor, avg(contribution/d2) AS share,
  count(*) AS n FROM parts WHERE side = 'failure' AND score > thr GROUP BY op, class, sensor HAVING count(*) >= 3)
SELECT op, class, sensor, {r('share', 6)} AS share, n, row_number() OVER (PARTITION BY op, class
  ORDER BY share DESC, sensor) = 1 AS dominant FROM m""")
def _(spark, d):
    made = views.contribution_shares(model(spark, d), sel.failure_runs(runs(spark, d)))
    return made.withColumn("share", rd("share", 6))


@query("mean_contributions", _PARTS_LONG + f""", m AS (SELECT op, sensor, avg(contribution) AS c FROM parts
  WHERE side = 'failure' GROUP BY op, sensor)
SELECT op, sensor, {r('c', 6)} AS contribution, CAST(row_number() OVER (PARTITION BY op ORDER BY c DESC, sensor) AS INT) AS rank FROM m""")
def _(spark, d):
    made = views.mean_contributions(model(spark, d), sel.failure_runs(runs(spark, d)))
    return made.withColumn("contribution", rd("contribution", 6))


@query("false_positive_rate", scored("ledoit_wolf") + f"SELECT op, {r('avg(CAST(flagged AS DOUBLE))', 6)} AS fpr, "
       "count(*) AS n FROM scored WHERE side = 'nominal' GROUP BY op")
def _(spark, d):
    t = model(spark, d).false_positive_rate(nominal(spark, d))
    return t.select("op", rd("fpr", 6).alias("fpr"), "n")


_RATES = f"""SELECT op, {r("avg(CAST(flagged AS DOUBLE)) FILTER (WHERE side = 'nominal')", 6)} AS nominal_rate,
  count(*) FILTER (WHERE side = 'nominal') AS nominal_n,
  {r("avg(CAST(flagged AS DOUBLE)) FILTER (WHERE side = 'failure')", 6)} AS failure_rate,
  count(*) FILTER (WHERE side = 'failure') AS failure_n FROM scored GROUP BY op"""


@query("detection_rates", scored("ledoit_wolf") + _RATES)
def _(spark, d):
    t = views.detection_rates(fitted_scores(spark, d))
    return t.withColumns({c: rd(c, 6) for c in ("nominal_rate", "failure_rate")})


@query("distance_summary", scored("ledoit_wolf") + f"""SELECT op, side AS "set", count(*) AS n,
  {r('avg(score)', 6)} AS mean, {r('stddev_pop(score)', 6)} AS std, {r('max(score)', 6)} AS max
  FROM scored GROUP BY op, side""")
def _(spark, d):
    t = views.distance_summary(fitted_scores(spark, d), ["op", "set"])
    return t.withColumns({c: rd(c, 6) for c in ("mean", "std", "max")})


@query("chain_comparison", f"""WITH {runs_cte()}, lw AS (WITH {Q.fit_cte('ledoit_wolf')} {_RATES}),
  em AS (WITH {Q.fit_cte('empirical', calib=0.0, rule='chi2')} {_RATES}),
  ds AS (WITH {Q.fit_cte('diagonal')} {_RATES})
SELECT 'diagonal' AS chain, ds.* FROM ds UNION ALL SELECT 'lw', lw.* FROM lw UNION ALL SELECT 'plain', em.* FROM em""")
def _(spark, d):
    chains = [Mahalanobis(alpha=0.01, chain="lw"),
              Mahalanobis(alpha=0.01, cov="empirical", threshold="chi2", calib_fraction=0.0, chain="plain"),
              Mahalanobis(alpha=0.01, cov="diagonal", chain="diagonal")]
    ds = Dataset.from_runs(runs(spark, d), S7)
    t = views.detection_rates(ModelBank.fit(ds, chains).score_dataset(ds), ["chain", "op"])
    return t.withColumns({c: rd(c, 6) for c in ("nominal_rate", "failure_rate")})


@query("bank_table")
def _(spark, d):
    bank = ModelBank.fit(Dataset.from_runs(runs(spark, d), S7), DEFAULT)
    return bank.to_frame().withColumns({"threshold": rd("threshold", 4), "cond": rd("cond", 2)})


@query("bank_overview", scored("ledoit_wolf") + f"""SELECT op, 'default' AS chain, 'FittedMahalanobis' AS model,
  CAST(n AS BIGINT) AS n_train, 4 AS sensors_used, 'empirical' AS rule, {r('thr', 6)} AS threshold
  FROM models JOIN limits USING (op)""")
def _(spark, d):
    bank = ModelBank.fit(Dataset.from_runs(runs(spark, d), S7), DEFAULT)
    return bank.to_frame().select("op", "chain", "model", "n_train", "sensors_used", "rule",
                                  rd("threshold", 6).alias("threshold"))


@query("score_mcd")
def _(spark, d):
    t = fitted_scores(spark, d, Mahalanobis(cov="mcd", scaler="robust", threshold="chi2", alpha=0.01))
    return t.groupBy("op", "set").agg(F.count(F.lit(1)).alias("n"), rd(F.avg("score"), 3).alias("mean"))


@query("score_eigen_embeddings")
def _(spark, d):
    rows, names = embeddings(spark, d)
    m = Mahalanobis(inverse="eigen", var_explained=0.9, threshold="chi2").fit(
        sel.nominal_runs(rows), names)
    return m.predict(rows).select("run_id", "set", "class", rd("score", 3).alias("score"), "flagged")


_E8 = [f"e{j}" for j in range(8)]
_EMB = ("SELECT CAST(vec_id AS STRING) AS run_id, 'EM' AS op, "
        "CASE WHEN label = 0 THEN 'nominal' ELSE 'failure' END AS side, "
        "CASE WHEN label <> 0 THEN CAST(label AS STRING) END AS class, "
        "CASE WHEN label <> 0 THEN CAST(vec_id % 100 AS DOUBLE) END AS intensity, "
        + ", ".join(f"CAST(embedding[{j + 1}] AS DOUBLE) AS e{j}" for j in range(8))
        + " FROM embeddings")


@query("score_embeddings", f"""WITH {runs_cte(_EMB)}, {Q.fit_cte('ledoit_wolf', calib=0.0, rule='chi2', chi2=20.090235029663233, sensors=_E8)}
  SELECT run_id, {r('score', 4)} AS score, flagged FROM scored""")
def _(spark, d):
    rows, names = embeddings(spark, d, 8)
    m = Mahalanobis(threshold="chi2", alpha=0.01, calib_fraction=0.0).fit(
        sel.nominal_runs(rows), names)
    return m.predict(rows).select("run_id", rd("score", 4).alias("score"), "flagged")


# -- detectability -----------------------------------------------------------------------------------

_FR = scored("ledoit_wolf") + Q.FRAME


def _pod(spark, d, **kw):
    kw.setdefault("n_boot", 0)
    return pod_analysis(model(spark, d), runs(spark, d), **kw)


@query("score_frame", scored("ledoit_wolf") + f"""SELECT run_id, op, class, {r('abs(intensity)', 4)} AS intensity,
  {r('intensity', 4)} AS intensity_signed, {r('score', 4)} AS score, flagged AS detected
  FROM scored WHERE side = 'failure'""")
def _(spark, d):
    t = score_frame(model(spark, d), runs(spark, d))
    return t.select("run_id", "op", "class", rd("intensity", 4).alias("intensity"),
                    rd("intensity_signed", 4).alias("intensity_signed"),
                    rd("score", 4).alias("score"), "detected")


_BIN_COLS = ("center", "lo", "hi", "rate", "ci_lo", "ci_hi")


@query("empirical_pod", _FR + Q.BINS + f" SELECT op, class, CAST(bin AS INT) AS bin, {', '.join(r(c, 6) + f' AS {c}' for c in _BIN_COLS)}, n, k FROM bins")
def _(spark, d):
    t = _pod(spark, d).bins.drop("chain")
    return t.withColumns({c: rd(c, 6) for c in _BIN_COLS})


@query("empirical_crossing", _FR + Q.BINS + f" SELECT op, class, {r('i50_emp', 6)} AS i50_emp, {r('i90_emp', 6)} AS i90_emp FROM cross0")
def _(spark, d):
    return _pod(spark, d).result.select(
        "op", "class", rd("i50_emp", 6).alias("i50_emp"), rd("i90_emp", 6).alias("i90_emp"))


_FIT_COLS = {"b0": 4, "b1": 4, "i50": 3, "i90": 3}


@query("pod_fit", Q.recursive(_FR + Q.pod_cte()) + f" SELECT op, class, n, detected, fitted, separated, "
       + ", ".join(f"{r(c, k)} AS {c}" for c, k in _FIT_COLS.items()) + " FROM pod")
def _(spark, d):
    return _pod(spark, d).result.select(
        "op", "class", "n", "detected", "fitted", "separated",
        *[rd(c, k).alias(c) for c, k in _FIT_COLS.items()])


@query("pod_table", Q.recursive(_FR + Q.BINS + Q.pod_cte()) + f""" SELECT op, class,
  CASE WHEN detected = 0 THEN 'never detected' WHEN separated THEN 'always detected' ELSE 'fitted' END AS state,
  n, detected, {r('detected/CAST(n AS DOUBLE)', 6)} AS detection_rate, {r('i50', 3)} AS i50, {r('i90', 3)} AS i90,
  {r('i50_emp', 6)} AS i50_emp, {r('i90_emp', 6)} AS i90_emp, {r('i_max', 6)} AS i_max
  FROM pod JOIN cross0 USING (op, class)""")
def _(spark, d):
    ds = Dataset.from_runs(runs(spark, d), S7)
    t = detectability_summary(ModelBank.fit(ds, DEFAULT), ds, n_boot=0)
    six = ("detection_rate", "i50_emp", "i90_emp", "i_max")
    return t.select("op", "class", "state", "n", "detected", *[rd(c, 6).alias(c) for c in six],
                    rd("i50", 3).alias("i50"), rd("i90", 3).alias("i90"))


@query("training_floor", Q.recursive(_FR + Q.pod_cte()) + f" SELECT op, class, {r('least(i50, i90)', 3)} AS train_above FROM pod")
def _(spark, d):
    t = detectability.training_floor(_pod(spark, d))
    return t.select("op", "class", rd("train_above", 3).alias("train_above"))


@query("pod_curve", Q.recursive(_FR + Q.pod_cte()) + f""", grid AS (SELECT op, class, b0, b1, i, i_min *
  exp(ln(i_max/i_min)/199e0 * i) AS x FROM pod, range(200) t(i) WHERE fitted AND b1 > 0e0)
SELECT op, class, CAST(i AS INT) AS point, {r('x', 4)} AS intensity,
  {r('1e0/(1e0 + exp(-(b0 + b1*ln(x))))', 4)} AS pod FROM grid""")
def _(spark, d):
    t = _pod(spark, d).curve()
    return t.select("op", "class", "point", rd("intensity", 4).alias("intensity"), rd("pod", 4).alias("pod"))


_ALPHAS = [0.05, 0.01, 0.001]


@query("alpha_tradeoff", Q.recursive(scored("ledoit_wolf") + f""", lim AS ({" UNION ALL ".join(
    f"SELECT op, {a!r}e0 AS alpha, quantile_cont(score, {1.0 - a!r}) AS cut FROM scored WHERE side = 'nominal' GROUP BY op" for a in _ALPHAS)}),
frame AS (SELECT op, alpha, class, abs(intensity) AS x, score > cut AS hit FROM scored JOIN lim USING (op) WHERE side = 'failure')"""
    + Q.pod_cte("op, alpha, class")) + f""" SELECT op, CAST(alpha AS DOUBLE) AS alpha, {r('median(i90)', 3)} AS median_i90,
  {r('max(i90)', 3)} AS worst_i90, count(i90) AS n_finite, count(*) AS n_classes FROM pod GROUP BY op, alpha""")
def _(spark, d):
    t = detectability.alpha_tradeoff(_pod(spark, d, at_alpha=_ALPHAS))
    return t.withColumns({"median_i90": rd("median_i90", 3), "worst_i90": rd("worst_i90", 3)})


@query("pod_bootstrap")
def _(spark, d):
    t = _pod(spark, d, n_boot=200).result
    return t.select("op", "class", rd("i90", 3).alias("i90"), rd("i90_95", 3).alias("i90_95"))


@query("pod_bootstrap_bounds", f"""WITH {runs_cte()} SELECT DISTINCT op, class, TRUE AS above, TRUE AS near
  FROM runs WHERE side = 'failure'""")
def _(spark, d):
    t = _pod(spark, d, n_boot=200).result
    ratio = F.col("i90_95") / F.col("i90")
    return t.select("op", "class", (ratio >= 1).alias("above"), (ratio <= 1.1).alias("near"))


@query("pod_replicates", f"""WITH {runs_cte()}, c AS (SELECT DISTINCT op, class FROM runs WHERE side = 'failure')
SELECT op, class, CAST(i AS INT) AS replicate, TRUE AS near FROM c, range(1, 201) AS t(i)""")
def _(spark, d):
    pod = _pod(spark, d, n_boot=200)
    fitted = pod.result.select("op", "class", F.col("i90").alias("own"))
    near = F.col("i90").between(F.col("own") / 1.25, F.col("own") * 1.25)
    return pod.replicates().join(fitted, ["op", "class"]).select("op", "class", "replicate", near.alias("near"))


_SENS = ", ".join(
    f"regr_slope(z_{s}, x) AS slope_{s}, avg(abs(z_{s})) FILTER (WHERE x >= cut) AS dev_{s}, "
    f"covar_pop(z_{s}, x)/(stddev_pop(z_{s})*stddev_pop(x)) AS r_{s}, count(z_{s}) AS n_{s}" for s in S4)
_SENS_SQL = f"""WITH {runs_cte()}, {_SC}, z AS (SELECT op, class, abs(intensity) AS x,
  {", ".join(f"({s} - c_{s})/t_{s} AS z_{s}" for s in S4)} FROM runs JOIN sc USING (op) WHERE side = 'failure'),
c AS (SELECT op, class, quantile_cont(x, 0.9) AS cut FROM z GROUP BY op, class),
m AS (SELECT op, class, {_SENS} FROM z JOIN c USING (op, class) GROUP BY op, class),
l AS ({" UNION ALL ".join(f"SELECT op, class, '{s}' AS sensor, slope_{s} AS slope, dev_{s} AS dev_high, r_{s} AS r, n_{s} AS n FROM m" for s in S4)})"""
_SENS_OUT = f"op, class, sensor, {r('slope', 6)} AS slope, {r('dev_high', 6)} AS dev_high, {r('r', 6)} AS r, n"


@query("sensor_sensitivity", f"{_SENS_SQL} SELECT {_SENS_OUT} FROM l")
def _(spark, d):
    t = views.sensor_sensitivity(runs(spark, d), S4)
    return t.withColumns({c: rd(c, 6) for c in ("slope", "dev_high", "r")})


@query("sensitivity_topk", f"""{_SENS_SQL}, o AS (SELECT *, CAST(row_number() OVER (PARTITION BY op, class
  ORDER BY abs(slope) DESC, sensor) AS INT) AS rank FROM l) SELECT {_SENS_OUT}, rank FROM o WHERE rank <= 2""")
def _(spark, d):
    t = views.sensitivity_topk(views.sensor_sensitivity(runs(spark, d), S4), top=2)
    return t.withColumns({c: rd(c, 6) for c in ("slope", "dev_high", "r")})


# -- views ---------------------------------------------------------------------------------------------

@query("most_responsive", f"""WITH {runs_cte()}, {_SC}, m AS ({" UNION ALL ".join(
    f"SELECT op, '{s}' AS sensor, avg(abs(({s} - c_{s})/t_{s})) AS v FROM runs JOIN sc USING (op) WHERE side = 'failure' GROUP BY op" for s in S4)}),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY op ORDER BY v DESC, sensor) AS INT) AS rank FROM m)
SELECT op, sensor, {r('v', 6)} AS deviation, rank FROM o WHERE rank <= 3""")
def _(spark, d):
    return views.most_responsive(runs(spark, d), S4, 3).withColumn("deviation", rd("deviation", 6))


def _binned_sql(keys: str, n_bins: int = 12) -> str:
    return Q.edges_cte("pts", keys, "x", n_bins, 5) + f"""
SELECT {keys}, CAST(bin AS INT) AS bin, {r('median(x)', 6)} AS center, {r('any_value(e)[bin + 1]', 6)} AS lo,
  {r('any_value(e)[bin + 2]', 6)} AS hi, {r('median(y)', 5)} AS median, {r('quantile_cont(y, 0.25)', 5)} AS q25,
  {r('quantile_cont(y, 0.75)', 5)} AS q75, count(*) AS n FROM placed GROUP BY {keys}, bin"""


_BINNED = {"center": 6, "lo": 6, "hi": 6, "median": 5, "q25": 5, "q75": 5}


def _rounded_bins(t: DataFrame) -> DataFrame:
    return t.withColumns({c: rd(c, k) for c, k in _BINNED.items()})


@query("binned_stats", f"WITH {runs_cte()}, pts AS (SELECT op, class, intensity AS x, s1 AS y FROM runs "
       "WHERE side = 'failure')" + _binned_sql("op, class"))
def _(spark, d):
    rows = sel.failure_runs(runs(spark, d))
    return _rounded_bins(binning.binned_stats(rows, ["op", "class"], "intensity", "s1"))


@query("score_vs_intensity", _FR + ", pts AS (SELECT op, class, x, score AS y FROM frame)" + _binned_sql("op, class"))
def _(spark, d):
    t = views.score_vs_intensity(score_frame(model(spark, d), runs(spark, d)))
    return _rounded_bins(t.drop("threshold"))


@query("trend_vs_intensity", f"""WITH {runs_cte()}, {_SC}, pts AS ({" UNION ALL ".join(
    f"SELECT op, class, '{s}' AS sensor, abs(intensity) AS x, ({s} - c_{s})/t_{s} AS y FROM runs JOIN sc USING (op) WHERE side = 'failure'"
    for s in ("s1", "s2"))})""" + _binned_sql("op, class, sensor"))
def _(spark, d):
    return _rounded_bins(views.trend_vs_intensity(runs(spark, d), ["s1", "s2"]))


def _hist_sql(bins: int, keys: str) -> str:
    return f""", ends AS (SELECT {keys}, min(v) AS a, max(v) AS b, count(*) AS m FROM vals GROUP BY {keys}),
slots AS (SELECT {keys}, a, b, m, least({bins - 1}, floor((v - a)/((b - a)/{bins}e0))) AS bin FROM vals JOIN ends USING ({keys}))
SELECT {keys}, CAST(bin AS INT) AS bin, {r(f'any_value(a) + bin*((any_value(b) - any_value(a))/{bins}e0)', 5)} AS lo,
  count(*) AS count, {r(f'count(*)/(any_value(m)*((any_value(b) - any_value(a))/{bins}e0))', 5)} AS density FROM slots GROUP BY {keys}, bin"""


@query("sensor_histograms", f"""WITH {runs_cte()}, vals AS ({" UNION ALL ".join(
    f"SELECT op, '{s}' AS sensor, {s} AS v FROM runs WHERE side = 'nominal'" for s in S4)})""" + _hist_sql(40, "op, sensor"))
def _(spark, d):
    t = views.sensor_histograms(runs(spark, d), S4, standardize=False)
    return t.select("op", "sensor", "bin", rd("lo", 5).alias("lo"), "count", rd("density", 5).alias("density"))


@query("score_histograms", scored("ledoit_wolf") + ", vals AS (SELECT op, side, score AS v FROM scored)"
       + _hist_sql(60, "op, side").replace("SELECT op, side, CAST", 'SELECT op, side AS "set", CAST'))
def _(spark, d):
    t = views.score_histograms(fitted_scores(spark, d))
    return t.select("op", "set", "bin", rd("lo", 5).alias("lo"), "count", rd("density", 5).alias("density"))


_ELL = f"""WITH {runs_cte()}, m AS (SELECT op, avg(s1) AS mx, avg(s2) AS my, var_samp(s1) AS a, var_samp(s2) AS c,
  covar_samp(s1, s2) AS b FROM runs WHERE side = 'nominal' GROUP BY op)"""


@query("ellipse", f"""{_ELL}, x AS (SELECT *, (a + c)/2e0 AS mid, (a - c)/2e0 AS gap, sqrt(gap*gap + b*b) AS root,
  sqrt(mid + root) AS r1, sqrt(greatest(mid - root, 0e0)) AS r2, atan2(b, gap)/2e0 AS ang FROM m),
t AS (SELECT *, i * {2 * 3.141592653589793 / 99!r} AS th FROM x, range(100) g(i))
SELECT op, CAST(i AS INT) AS point, {r('mx + 3e0*r1*cos(th)*cos(ang) - 3e0*r2*sin(th)*sin(ang)', 3)} AS x,
  {r('my + 3e0*r1*cos(th)*sin(ang) + 3e0*r2*sin(th)*cos(ang)', 3)} AS y FROM t""")
def _(spark, d):
    t = views.ellipse_points(views.ellipse_facts(runs(spark, d), "s1", "s2"), 3.0, 100)
    return t.select("op", "point", rd("x", 3).alias("x"), rd("y", 3).alias("y"))


@query("inside_ellipse", f"""{_ELL} SELECT op, class, count(*) AS n, count(*) FILTER (WHERE
  (c*(s1-mx)*(s1-mx) - 2e0*b*(s1-mx)*(s2-my) + a*(s2-my)*(s2-my))/(a*c - b*b) <= 9e0) AS inside
  FROM runs JOIN m USING (op) GROUP BY op, class""")
def _(spark, d):
    rows = runs(spark, d)
    t = views.inside_ellipse(rows, views.ellipse_facts(rows, "s1", "s2"), "s1", "s2")
    return t.groupBy("op", "class").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("inside"))


@query("zoom", f"WITH {runs_cte()} SELECT run_id, {r('s1', 6)} AS s1, {r('s2', 6)} AS s2 FROM runs "
       "WHERE s1 BETWEEN 20e0 AND 60e0 AND s2 BETWEEN 0e0 AND 30000e0")
def _(spark, d):
    t = views.zoom(runs(spark, d), "s1", "s2", (20.0, 60.0), (0.0, 30000.0))
    return t.select("run_id", rd("s1", 6).alias("s1"), rd("s2", 6).alias("s2"))


@query("pca_projection")
def _(spark, d):
    rows = runs(spark, d)
    t = views.project_pca(rows, views.fit_pca(rows, S4), S4, ["run_id", "op", "set"])
    return t.select("run_id", "op", "set", rd("pc1", 3).alias("pc1"), rd("pc2", 3).alias("pc2"))


@query("pca_ratio")
def _(spark, d):
    t = views.fit_pca(runs(spark, d), S4)
    return t.select("op", F.posexplode("ratio").alias("component", "ratio")).withColumn("ratio", rd("ratio", 6))
