"""Helpers of this folder: stored tables, fold remainders, ordered slices, link components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runwatch import runtime


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a NULL id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the session's checkpoint folder and read it back.

    Unlike ``checkpoint()`` the table is compressed and later reads prune columns.
    """
    runtime._prepare_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: most bytes of a batch on its way to or from Python
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df`` as it is, with the session's bound on the bytes of an Arrow batch at most ``BATCH_BYTES``.

    A batch is doubled while it is filled and copied on the way, on every core, so long texts
    need a bound in bytes and not in rows.  A lower bound of the session stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    units = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils
    if not 0 < units.byteStringAsBytes(df.sparkSession.conf.get(key)) <= BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_slices(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range-partition narrow rows by ``order``, number the slices in ``_slice`` and store them.

    Slices follow each other in the given order and have about the same number of rows,
    whatever key is hot, as long as ``order`` breaks ties.  Every row of slice i comes
    before every row of slice i + 1.
    """
    parts = shuffle_width(df.sparkSession)
    ranged = df.repartitionByRange(parts, *order).withColumn("_slice", F.spark_partition_id())
    return stored(ranged)


def neighbours(df: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """Append ``next_<c>`` for each column: the value of the following row, the last wraps round.

    The rows are cut into ordered slices; only the first row of each slice crosses a border.
    An empty table stays empty; a single row is its own successor.
    """
    sliced = ordered_slices(df, order)
    inside = Window.partitionBy("_slice").orderBy(*order)
    packed = F.struct(*[F.col(c).alias(f"next_{c}") for c in columns])
    led = sliced.withColumn("_next", F.lead(packed).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1)
    # one row per slice: its first row, handed to the slice before it; the first one wraps
    heads = led.where("_first").select("_slice", packed.alias("_head"))
    line = Window.orderBy("_slice")
    heads = heads.select(
        F.coalesce(F.lag("_slice").over(line), F.max("_slice").over(
            line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_slice"),
        "_head")
    joined = led.join(F.broadcast(heads), "_slice", "left")
    return joined.withColumn("_next", F.coalesce("_next", "_head")).select(*df.columns, "_next.*")


def prefix_sums(df: DataFrame, group: str, order: list[Column], value: str) -> DataFrame:
    """Append ``before``: the sum of ``value`` over the rows of the group that come earlier.

    A group may hold any share of the rows: it is cut into ordered slices, the running sum is
    taken inside a slice, and the sums of whole slices (one row per group and slice) are added.
    ``group`` must not be NULL.
    """
    spark = df.sparkSession
    keys = [F.col(group), *order]
    sliced = ordered_slices(df, keys)
    sums = sliced.groupBy(group, "_slice").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runtime.materialise(
        sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum"))
    inside = Window.partitionBy(group, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    running = sliced.withColumn("before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    whole = runtime.attach(running, offsets, [group, "_slice"], row_bytes=64)
    return whole.withColumn("before", F.col("before") + F.col("_offset")).drop("_offset", "_slice")


def components(links: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """``(id, component_id)`` for every id that occurs in ``links``; the smallest reachable id.

    Alternating large-star and small-star steps.  A hub never gathers its neighbours in one
    task: its smallest neighbour comes from a partial aggregate and is stored, so that the join
    back stands alone and Spark can split or broadcast it.  Stops when a step changes nothing; raises if ``rounds`` steps are not enough.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    edges = runtime.materialise(edges.where("u != v").distinct())

    def mark(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    state = mark(edges)
    for _ in range(rounds):
        if state[0] == 0:
            break
        both = edges.union(edges.select("v", "u"))
        low = runtime.materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        large = runtime.materialise(large)
        low = runtime.materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        linked = large.join(low, "u")
        small = linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = runtime.materialise(small.where("u != v").distinct())
        before, state = state, mark(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return members.union(edges.select("v", "v").distinct())
