"""Finding run files and pairing nominal with failure tables."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: words that mark a file's role, words and folder names that say nothing
NOMINAL_TOKENS = (
    "nominal", "nominale", "nom", "base", "baseline", "ref", "reference",
    "healthy", "sano", "ok",
)
FAILURE_TOKENS = (
    "failures", "failure", "fail", "faults", "fault", "guasti", "guasto",
    "anomaly", "anomalies", "anomal", "degraded", "ko",
)
IGNORED_TOKENS = ("table", "data", "csv")
GENERIC_FOLDERS = ("data", "dataset", "csv", "input", "inputs", "raw")
FAILURE_PARTS = "failure|fault|guast"
NOMINAL_PARTS = "nominal"


def list_csv(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Paths of the CSV files under ``root``; file contents are never read.

    The file system lists the folder itself, since Spark's readers pass over names
    that begin with ``_`` or ``.``.
    """
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(root)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, recursive)
    paths = []
    while files.hasNext():
        path = files.next().getPath().toString()
        if path.lower().endswith(".csv"):
            paths.append((path,))
    return spark.createDataFrame(paths, "path string")


def _words(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def file_tokens(stem: Column) -> Column:
    return F.filter(F.split(stem, "[^A-Za-z0-9]+"), lambda t: t != "")


def file_kind(tokens: Column) -> Column:
    """``failures``, ``nominal`` or NULL; a failure word wins over a nominal one."""
    low = F.transform(tokens, lambda t: F.lower(t))
    telling = F.get(F.filter(low, lambda t: t.rlike(f"{FAILURE_PARTS}|{NOMINAL_PARTS}")), F.lit(0))
    return (
        F.when(F.arrays_overlap(low, _words(FAILURE_TOKENS)), "failures")
        .when(F.arrays_overlap(low, _words(NOMINAL_TOKENS)), "nominal")
        .when(telling.rlike(FAILURE_PARTS), "failures")
        .when(telling.isNotNull(), "nominal")
    )


def pairing_key(tokens: Column, kind: Column) -> Column:
    """Name tokens without the words of the file's own role, case kept."""
    role = F.when(kind == "nominal", _words(NOMINAL_TOKENS)).otherwise(_words(FAILURE_TOKENS))
    return F.array_join(F.filter(tokens, lambda t: ~F.array_contains(
        F.concat(role, _words(IGNORED_TOKENS)), F.lower(t))), "_")


def shared_key(nominal: Column, failures: Column) -> Column:
    """Nominal-name tokens that the failure name has too and that are no role word."""
    other = F.transform(failures, lambda t: F.lower(t))
    plain = _words(NOMINAL_TOKENS + FAILURE_TOKENS + IGNORED_TOKENS)
    return F.array_join(F.filter(nominal, lambda t: F.array_contains(other, F.lower(t))
                                 & ~F.array_contains(plain, F.lower(t))), "_")


def describe_paths(paths: DataFrame, root: str) -> DataFrame:
    """``path, rel, dir, tokens, kind, key`` for every path under ``root``."""
    lead = root.rstrip("/") + "/"
    rel = F.when(F.startswith("path", F.lit(lead)), F.substr("path", F.lit(len(lead) + 1))).otherwise(
        F.col("path"))
    rows = paths.withColumn("rel", rel)
    rows = rows.withColumn("dir", F.regexp_extract("rel", r"^(.*)/[^/]*$", 1))
    stem = F.regexp_replace(F.regexp_extract("rel", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    rows = rows.withColumn("tokens", file_tokens(stem))
    rows = rows.withColumn("kind", file_kind(F.col("tokens")))
    return rows.withColumn("key", pairing_key(F.col("tokens"), F.col("kind")))


def pair_files(paths: DataFrame, root: str) -> DataFrame:
    """``name, dir, key, nominal, failures, status`` with status ``paired``, ``half``
    (only one role has the key), ``replaced`` (a later file has role and key) or
    ``unknown``; every file appears exactly once.
    """
    files = describe_paths(paths, root)
    per_dir = files.groupBy("dir").agg(
        F.count_if(F.col("kind") == "nominal").alias("n_nom"),
        F.count_if(F.col("kind") == "failures").alias("n_fail"))
    files = files.join(per_dir, "dir")
    alone = (F.col("n_nom") == 1) & (F.col("n_fail") == 1)
    files = files.withColumn("slot", F.when(alone, F.lit("")).otherwise(F.col("key")))
    files = files.withColumn("alone", alone)
    known = files.where("kind is not null")
    last = known.groupBy("dir", "slot", "alone", "kind").agg(
        F.max("rel").alias("rel"), F.max_by("tokens", "rel").alias("tokens"))
    side = lambda k: last.where(F.col("kind") == k).select(
        "dir", "slot", "alone", F.col("rel").alias(k), F.col("tokens").alias(f"{k}_tokens"))
    both = side("nominal").join(side("failures"), ["dir", "slot", "alone"], "full_outer")
    base = root.rstrip("/").rsplit("/", 1)[-1]
    fallback = "OP" if not base or base.lower() in GENERIC_FOLDERS else base
    in_root = F.col("dir") == ""
    filled = lambda c: F.when(c != "", c)
    by_dir = F.when(~in_root, F.replace(F.col("dir"), F.lit("/"), F.lit("_"))).otherwise(
        F.coalesce(filled(shared_key(F.col("nominal_tokens"), F.col("failures_tokens"))),
                   F.lit(fallback)))
    folder = F.when(in_root, F.lit(base)).otherwise(F.regexp_extract("dir", r"([^/]*)$", 1))
    by_key = F.coalesce(filled(F.col("slot")), filled(folder), F.lit("OP"))
    paired = F.col("nominal").isNotNull() & F.col("failures").isNotNull()
    out = both.select(
        F.when(paired, F.when(F.col("alone"), by_dir).otherwise(by_key)).alias("name"),
        "dir", F.col("slot").alias("key"), "nominal", "failures",
        F.when(paired, "paired").otherwise("half").alias("status"),
    )
    empty = F.lit(None).cast("string")
    rest = lambda rows, status: rows.select(
        empty.alias("name"), "dir", "key",
        F.when(F.col("kind") == "nominal", F.col("rel")).alias("nominal"),
        F.when(~F.coalesce(F.col("kind") == "nominal", F.lit(False)), F.col("rel")).alias("failures"),
        F.lit(status).alias("status"))
    older = known.join(last.select("dir", "slot", "kind", "rel"),
                       ["dir", "slot", "kind", "rel"], "left_anti")
    return _unique_names(out).unionByName(rest(older, "replaced")).unionByName(
        rest(files.where("kind is null"), "unknown"))


def free_name(taken: set[str], name: str) -> str:
    """``name``, or with the first of _2, _3, ... that is not taken; it is taken from now on."""
    found, turn = name, 1
    while found in taken:
        turn += 1
        found = f"{name}_{turn}"
    taken.add(found)
    return found


def _unique_names(pairs: DataFrame) -> DataFrame:
    """Repeated names get the next free number, in directory and key order.

    Only names that agree up to trailing numbers can collide, so each such family
    is named by itself; halves of pairs have no name and take no part.
    """
    def settle(family: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        ordered = family.sort_values(["dir", "key"], kind="stable")
        return ordered.assign(name=[free_name(taken, n) for n in ordered["name"]]).drop(columns="_family")

    named = pairs.where("name IS NOT NULL").withColumn(
        "_family", F.regexp_replace("name", r"(_[0-9]+)+$", ""))
    settled = named.groupBy("_family").applyInPandas(settle, pairs.schema)
    return settled.unionByName(pairs.where("name IS NULL"))


def catalog_runs(spark: SparkSession, root: str, recursive: bool = True) -> dict:
    """Propose a manifest for the CSV files under ``root``; nothing is dropped silently."""
    full = list_csv(spark, root, recursive)
    prefix = os.path.abspath(root) if "://" not in root else root
    local = full.select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    rows = sorted(pair_files(local, prefix).collect(), key=lambda r: (r["dir"], r["key"] or ""))
    file_of = lambda r: r["nominal"] or r["failures"]
    ops = {r["name"]: {"nominal": r["nominal"], "failures": r["failures"]}
           for r in rows if r["status"] == "paired"}
    return {
        "root": prefix, "operating_points": ops,
        "columns": {"label": None, "intensity": None, "exclude": []},
        "intensity_mode": "auto",
        "unmatched": sorted(file_of(r) for r in rows if r["status"] != "paired"),
        "notes": [f"{r['dir'] or '.'}: key {r['key']!r} has one file only: {file_of(r)}"
                  for r in rows if r["status"] == "half"],
    }


def write_manifest(spark: SparkSession, manifest: dict, path: str) -> str:
    """Indented JSON, one text file in the folder ``path`` on any file system."""
    text = json.dumps(manifest, indent=2, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def read_manifest(spark: SparkSession, path: str) -> dict:
    """Read back a manifest file or folder; a relative root is taken from its location."""
    manifest = json.loads(spark.read.text(path, wholetext=True).first()[0])
    root = manifest.get("root") or ""
    if not root.startswith("/") and "://" not in root:
        home = os.path.dirname(os.path.abspath(path)) if "://" not in path else path.rsplit("/", 1)[0]
        root = os.path.normpath(os.path.join(home, root)) if "://" not in home else f"{home}/{root}"
    manifest["root"] = root
    return manifest
