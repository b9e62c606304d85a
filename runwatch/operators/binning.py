"""Quantile bins of one column and robust summaries of another inside them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, with_count
from ..runtime import attach, materialise, stored
from .quantiles import EXACT_ROWS, grouped_quantiles, spread_fractions


@dataclass
class Edges:
    """The edge table with the facts later steps would otherwise have to count."""

    table: DataFrame
    groups: int
    largest: int
    bins: int


def bin_edges(
    rows: DataFrame, keys: list[str], x: str, n_bins: int, min_count: int,
    weight: str | None = None, exact_rows: int | None = None,
) -> Edges:
    """``keys, n, edges ARRAY<DOUBLE>``: distinct quantile edges per group.

    A group of n rows gets max(1, min(n_bins, n // min_count)) bins before equal
    edges merge; a group with one single value gets [v, v + 1e-12].
    """
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    rows = rows.where(F.col(x).isNotNull())
    share = F.floor(F.col("n") / F.lit(max(min_count, 1)))
    sizes = materialise(
        rows.groupBy(*keys).agg(F.sum(times).alias("n")).withColumn(
            "nb", F.greatest(F.lit(1), F.least(F.lit(n_bins), share)).cast("int"))
    )
    facts = sizes.agg(
        F.max("n").alias("largest"), F.count(F.lit(1)).alias("groups"),
        F.collect_set("nb").alias("nb"),
    ).first()
    fractions, start = spread_fractions(facts["nb"] or [1])
    q = grouped_quantiles(rows, keys, x, fractions, sizes.select(*keys, "n"), exact_rows, weight,
                          facts["largest"] or 0)
    at = F.create_map(*[F.lit(v) for nb, s in start.items() for v in (nb, s + 1)])
    own = F.array_distinct(F.slice("q", at[F.col("nb")], F.col("nb") + 1))
    low = own[0]
    edges = F.when(F.size(own) < 2, F.array(low, low + F.lit(1e-12))).otherwise(own)
    made = materialise(
        q.drop("n").join(F.broadcast(sizes) if facts["groups"] < 100_000 else sizes, keys)
        .select(*keys, "n", edges.alias("edges")))
    return Edges(made, facts["groups"], facts["largest"] or 0, max(facts["nb"] or [1]))


def assign_bins(rows: DataFrame, edges: Edges, keys: list[str], x: str) -> DataFrame:
    """Adds ``bin, lo, hi`` by comparing with the group's edges (no shuffle).

    The bin is the number of inner edges at or below x; the last one is closed on the right.
    """
    inner = F.slice("edges", 2, F.size("edges") - 2)
    table = edges.table.select(*keys, "edges", inner.alias("_inner"))
    joined = attach(rows, table, keys, row_bytes=512, rows=edges.groups)
    joined = with_count(joined, "bin", "_inner", x, edges.bins - 1)
    return joined.withColumns({
        "lo": F.col("edges")[F.col("bin")], "hi": F.col("edges")[F.col("bin") + 1],
    }).drop("edges", "_inner")


def binned_stats(
    df: DataFrame, keys: list[str], x: str, y: str, n_bins: int = 12, min_count: int = 5,
    exact_rows: int | None = None,
) -> DataFrame:
    """``keys, bin, center, lo, hi, median, q25, q75, n`` over quantile bins of x."""
    # the edges and the quantiles in the bins read these rows many times: compute them once
    rows = stored(df.select(*keys, finite(F.col(x)).alias("_x"), finite(F.col(y)).alias("_y")))
    return stats_in_bins(rows, keys, n_bins, min_count, exact_rows)


def stats_in_bins(
    rows: DataFrame, keys: list[str], n_bins: int = 12, min_count: int = 5, exact_rows: int | None = None,
) -> DataFrame:
    """``binned_stats`` of ``_y`` over bins of ``_x``, both finite or NULL; ``rows`` is read many times."""
    rows = rows.where(F.col("_x").isNotNull() & F.col("_y").isNotNull()).select(*keys, "_x", "_y")
    edges = bin_edges(rows, keys, "_x", n_bins, min_count, exact_rows=exact_rows)
    cell = [*keys, "bin"]
    placed = assign_bins(rows, edges, keys, "_x").select(*cell, "_x", "_y")
    counts = None
    if edges.largest > (EXACT_ROWS if exact_rows is None else exact_rows):
        counts = materialise(placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")))
    q = lambda v, ps: grouped_quantiles(
        placed, cell, v, ps, counts, exact_rows, largest=edges.largest)
    centers = q("_x", [0.5]).select(*cell, F.col("q")[0].alias("center"))
    spread = q("_y", [0.25, 0.5, 0.75])
    made = attach(spread.join(centers, cell), edges.table.select(*keys, "edges"), keys, row_bytes=512,
                  rows=edges.groups)
    return made.select(
        *keys, "bin", "center", F.col("edges")[F.col("bin")].alias("lo"),
        F.col("edges")[F.col("bin") + 1].alias("hi"), F.col("q")[1].alias("median"),
        F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), "n",
    )


def histogram(
    df: DataFrame, keys: list[str], value: str, bins: int = 40
) -> DataFrame:
    """Density histogram per group: ``keys, bin, lo, hi, count, density``.

    Equal bins between the smallest and largest finite value; a group with one
    value gets a unit-wide range around it.
    """
    rows = df.select(*keys, finite(F.col(value)).alias("_v")).where("_v is not null")
    ends = materialise(rows.groupBy(*keys).agg(
        F.min("_v").alias("a"), F.max("_v").alias("b"), F.count(F.lit(1)).alias("n")))
    flat = F.col("a") == F.col("b")
    ends = ends.select(
        *keys, "n", F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"),
        F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"),
    )
    width = (F.col("b") - F.col("a")) / F.lit(float(bins))
    slot = F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("a")) / width)).cast("int")
    counted = attach(rows, ends, keys).groupBy(*keys, "n", "a", "b", slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    return counted.select(
        *keys, "bin", (F.col("a") + F.col("bin") * width).alias("lo"),
        (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), "count",
        (F.col("count") / (F.col("n") * width)).alias("density"),
    )


def melt(df: DataFrame, keep: list[str], sensors: list[str], value: str = "value") -> DataFrame:
    """Long form ``keep, sensor, value`` of a few chosen sensors."""
    return df.unpivot(keep, sensors, "sensor", value)
