"""Exact random cuts, samples and splits without sorting a whole group.

A cut is the hash of the k-th run in a repeatable random order.  It is found digit
by digit: the runs of a group are counted by the next hexadecimal digits of their
hash, the counts tell in which of these buckets rank k lies, and so on until the
bucket holds at most ``BUCKET_ROWS`` runs.  Only those are sorted, so no task sees
more of a group, however large it is.  Hashes are spread evenly, so the scan that
counts also stores the runs around the share k / n of their range, and the bucket
is read from there; only if it lies elsewhere the runs are hashed again.  Once the
cut is known, splitting is a row-wise comparison.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_order
from ..runtime import attach, materialise, stored
from .quantiles import order_values

BUCKET_ROWS = 10_000
#: hexadecimal digits of a hash, and the most a pass counts by
HASH_DIGITS = 32
PASS_DIGITS = 4
#: how far around its expected place a cut is looked for, in standard deviations
AROUND = 8.0


def hash_cut(
    df: DataFrame,
    keys: list[str],
    run_id: str,
    take: DataFrame,
    seed: object,
    bucket_rows: int | None = None,
    largest: int | None = None,
    n_groups: int | None = None,
) -> DataFrame:
    """Per group the ``k``-th smallest (hash, run id); ``take`` is ``keys, n, k``.

    Returns ``keys, cut_hash, cut_id`` for groups with ``k >= 1``; exactly ``k``
    rows of the group are at or before the cut.
    """
    bucket_rows = BUCKET_ROWS if bucket_rows is None else bucket_rows
    rows = df.select(
        *keys, hash_order(F.col(run_id), seed).alias("_h"),
        F.col(run_id).cast("string").alias("_id"),
    )
    take = take.where(F.col("k") >= 1)
    if largest is None:
        largest = take.agg(F.max("n")).first()[0] or 0
    buckets = take.select(
        *keys, F.lit("").alias("_head"), F.col("k").alias("left"), F.col("n").alias("_inside"))
    depth = 0
    if largest > bucket_rows:
        buckets, depth, rows = _narrow_by_digits(rows, keys, materialise(buckets), bucket_rows, n_groups)
    else:
        rows = rows.withColumn("_c", F.lit(1).cast("bigint"))
    line = Window.partitionBy(*keys).orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = attach(rows, buckets.drop("_inside"), keys, rows=n_groups).where(
        F.startswith("_h", "_head") & (F.length("_head") < HASH_DIGITS))
    cuts = (
        inside.withColumn("_end", F.sum("_c").over(line))
        .where((F.col("_end") >= F.col("left")) & (F.col("_end") - F.col("_c") < F.col("left")))
        .select(*keys, F.col("_h").alias("cut_hash"), F.col("_id").alias("cut_id"))
    )
    if depth < HASH_DIGITS:
        return cuts
    # more runs than a bucket under one whole hash: they are one run id, repeated
    same = attach(rows, buckets.where(F.length("_head") == HASH_DIGITS).drop("_inside"), keys)
    return cuts.unionByName(same.where(F.col("_h") == F.col("_head")).groupBy(*keys).agg(
        F.first("_head").alias("cut_hash"), F.min("_id").alias("cut_id")))


def _narrow_by_digits(
    rows: DataFrame, keys: list[str], buckets: DataFrame, bucket_rows: int, n_groups: int | None
) -> tuple[DataFrame, int, DataFrame]:
    """``keys, _head, left, _inside``: the hash beginning of the bucket that holds the wanted rank
    and the rank inside it; at most ``bucket_rows`` runs share the beginning, or all their digits agree.
    Also how many digits were looked at, and ``rows`` with ``_c``, how many each stands for, or what of them
    is still needed."""
    depth, source = 0, rows.withColumn("_c", F.lit(1).cast("bigint"))
    found, buckets = source, buckets.withColumn("_near", F.lit(True))
    wide = F.col("_inside") > bucket_rows
    while depth < HASH_DIGITS:
        most, n_off = buckets.agg(F.max(F.when(wide, F.col("_inside"))), F.count_if(~F.col("_near"))).first()
        # groups that needed no more digits are read from the rows they were in: keep those as long as there are any
        source = source if n_off else found
        if most is None:
            break
        # buckets of about half the bound, but no more of them than a task can count by
        digits = min(PASS_DIGITS, HASH_DIGITS - depth, max(1, math.ceil(math.log(2 * most / bucket_rows, 16))))
        held = attach(source, buckets.where(wide).drop("_near"), keys, rows=n_groups).where(F.startswith("_h", "_head"))
        here, share = F.substring("_h", depth + 1, digits), F.col("left") / F.col("_inside")
        off = F.lit(AROUND) * F.sqrt(share * (1.0 - share) / F.col("_inside")) + 1.0 / F.col("_inside")
        slot = lambda x: F.lpad(F.lower(F.hex(F.floor(
            F.least(F.greatest(x, F.lit(0.0)) * 16 ** digits, F.lit(16 ** digits - 1))))), digits, "0")
        near = here.between(slot(share - off), slot(share + off))
        held = held.select(*keys, "_head", "left", "_h", "_id", "_c", here.alias("_digits"), near.alias("_near"))
        own = lambda c: F.when(F.col("_near"), F.col(c)).alias(c)
        values = stored(held.groupBy(*keys, "_head", "left", "_digits", "_near", own("_h"), own("_id"))
                        .agg(F.sum("_c").alias("_c")))
        line = Window.partitionBy(*keys).orderBy("_digits").rowsBetween(Window.unboundedPreceding, 0)
        counted = (
            values.groupBy(*keys, "_head", "left", "_digits", "_near")
            .agg(F.sum("_c").alias("c")).withColumn("end", F.sum("c").over(line)))
        before = F.col("end") - F.col("c")
        chosen = counted.where((F.col("end") >= F.col("left")) & (before < F.col("left"))).select(
            *keys, F.concat("_head", "_digits").alias("_head"), (F.col("left") - before).alias("left"),
            F.col("c").alias("_inside"), "_near")
        found = values.where("_near").select(*keys, "_h", "_id", "_c")
        buckets = materialise(buckets.where(~wide).withColumn("_near", F.lit(False)).unionByName(chosen))
        depth += digits
    return buckets.drop("_near"), depth, source


def before_cut(run_id: Column, seed: object) -> Column:
    # one comparison of pairs, so that the digest of a run is made once
    own = F.struct(hash_order(run_id, seed).alias("h"), run_id.cast("string").alias("i"))
    cut = F.struct(F.col("cut_hash").alias("h"), F.col("cut_id").alias("i"))
    return run_id.isNotNull() & F.col("cut_hash").isNotNull() & (own <= cut)


def mark_cut(
    df: DataFrame, keys: list[str], run_id: str, take: DataFrame, seed: object, name: str,
    bucket_rows: int | None = None,
) -> DataFrame:
    """Add Boolean ``name``: true for exactly ``k`` hash-ordered rows per group."""
    cuts = materialise(hash_cut(df, keys, run_id, take, seed, bucket_rows))
    return (
        attach(df, cuts, keys, how="left")
        .withColumn(name, before_cut(F.col(run_id), seed))
        .drop("cut_hash", "cut_id")
    )


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return materialise(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))


def split(
    df: DataFrame, keys: list[str], run_id: str = "run_id", test_size: float = 0.3,
    seed: object = 0, bucket_rows: int | None = None,
) -> DataFrame:
    """Plain split per group: ``is_test`` is true for exactly round(test_size * n) rows."""
    k = F.bround(F.lit(float(test_size)) * F.col("n")).cast("bigint")
    take = group_sizes(df, keys).withColumn("k", k)
    return mark_cut(df, keys, run_id, take, seed, "is_test", bucket_rows)


def subsample(
    df: DataFrame, keys: list[str], run_id: str = "run_id", max_points: int = 4000,
    seed: object = 0, bucket_rows: int | None = None,
) -> DataFrame:
    """Exactly ``max_points`` rows of every larger group; smaller groups stay whole."""
    take = group_sizes(df, keys).withColumn("k", F.least(F.col("n"), F.lit(max_points)))
    return mark_cut(df, keys, run_id, take, seed, "_in", bucket_rows).where("_in").drop("_in")


def rank_bins(
    df: DataFrame, keys: list[str], value: str, run_id: str = "run_id", n_bins: int = 5,
    seed: object = 0, name: str = "bin", bucket_rows: int | None = None,
) -> DataFrame:
    """Equal-count bins of ``value`` within each group, ties broken in hash order.

    The row of 1-based rank r out of n falls in bin ceil((r-1) q / (n-1)) - 1,
    not below 0, with q = min(n_bins, n).  Only the first row of every bin is
    looked up; each run is then placed by comparing it with those rows.  Runs
    without a value get bin 0.
    """
    bucket_rows = BUCKET_ROWS if bucket_rows is None else bucket_rows
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("_v"), F.col(run_id).cast("string").alias("_id")
    )
    sizes = group_sizes(rows, keys).withColumn("q", F.least("n", F.lit(n_bins)))
    # bin b >= 1 starts at the smallest r with (r-1) q > b (n-1)
    start = F.floor(F.col("b") * (F.col("n") - 1) / F.col("q")).cast("bigint") + 2
    starts = materialise(
        sizes.where("q > 1")
        .withColumn("b", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("q") - 1)))
        .select(*keys, "n", "b", start.alias("rank"))
    )
    firsts = _first_rows(rows, keys, starts, seed, bucket_rows)
    mark = F.struct("_v", "cut_hash", "cut_id")
    marks = materialise(firsts.groupBy(*keys).agg(F.collect_list(mark).alias("_marks")))
    here = F.struct(
        F.col(value).alias("_v"), hash_order(F.col(run_id), seed).alias("cut_hash"),
        F.col(run_id).cast("string").alias("cut_id"),
    )
    placed = attach(df, marks, keys, row_bytes=1024, how="left").withColumn("_here", here)
    passed = F.size(F.filter("_marks", lambda m: m <= F.col("_here")))
    usable = F.col(value).isNotNull() & F.col("_marks").isNotNull()
    return placed.withColumn(name, F.when(usable, passed).otherwise(0).cast("bigint")).drop(
        "_marks", "_here"
    )


def _first_rows(
    rows: DataFrame, keys: list[str], starts: DataFrame, seed: object, bucket_rows: int
) -> DataFrame:
    """The run at each wanted rank (by value, then hash): ``keys, _v, cut_hash, cut_id``."""
    hashed = rows.withColumn("cut_hash", hash_order(F.col("_id"), seed))
    order = Window.partitionBy(*keys).orderBy("_v", "cut_hash", "_id")
    small = starts.where(F.col("n") <= bucket_rows)
    near = (
        attach(hashed, small.select(*keys).distinct(), keys)
        .withColumn("rank", F.row_number().over(order))
        .join(F.broadcast(small.select(*keys, "rank")), [*keys, "rank"])
        .select(*keys, "_v", "cut_hash", F.col("_id").alias("cut_id"))
    )
    large = starts.where(F.col("n") > bucket_rows)
    largest = starts.agg(F.max("n")).first()[0] or 0
    if largest <= bucket_rows:
        return near
    # the value at the rank, then the right one among the runs sharing that value
    position = (F.col("rank") - 1).cast("double").alias("pos")
    edges = materialise(order_values(
        rows.select(*keys, "_v", F.lit(1).cast("bigint").alias("_c")), keys,
        large.select(*keys, "n", F.col("b").alias("i"), position), largest,
    ))
    ties = materialise(
        edges.join(large.select(*keys, F.col("b").alias("i"), "rank"), [*keys, "i"])
        .select(*keys, "i", F.col("x").alias("_v"), F.col("ties").alias("n"),
                (F.col("rank") - F.col("below")).alias("k")))
    tied = attach(rows, ties.select(*keys, "i", "_v"), [*keys, "_v"])
    cuts = hash_cut(
        tied, [*keys, "i"], "_id", ties.select(*keys, "i", "n", "k"), seed, bucket_rows
    )
    far = ties.join(cuts, [*keys, "i"]).select(*keys, "_v", "cut_hash", "cut_id")
    return near.unionByName(far)


def stratified_split(
    df: DataFrame, keys: list[str], label: str | None = "class",
    intensity: str | None = "intensity", run_id: str = "run_id", test_size: float = 0.3,
    n_bins: int = 5, seed: object = 0, bucket_rows: int | None = None,
) -> DataFrame:
    """Split by class and intensity bin: adds ``stratum`` and ``is_test``.

    Per stratum round(test_size * m) runs go to test, never all of them; a stratum
    of one run stays in train.
    """
    name = F.lit("all") if label is None else F.coalesce(F.col(label).cast("string"), F.lit("nan"))
    out = df.withColumn("_class", name)
    if intensity is not None and n_bins > 1:
        out = rank_bins(
            out.withColumn("_x", F.abs(F.col(intensity))), [*keys, "_class"], "_x", run_id,
            n_bins, seed, "_bin", bucket_rows,
        ).drop("_x")
        out = out.withColumn("stratum", F.concat_ws("|", "_class", F.col("_bin").cast("string")))
    else:
        out = out.withColumn("stratum", F.col("_class"))
    out = out.drop("_class", "_bin")
    wanted = F.bround(F.lit(float(test_size)) * F.col("n")).cast("bigint")
    take = group_sizes(out, [*keys, "stratum"]).withColumn(
        "k", F.when(F.col("n") < 2, 0).otherwise(F.least(wanted, F.col("n") - 1))
    )
    return mark_cut(out, [*keys, "stratum"], run_id, take, seed, "is_test", bucket_rows)
