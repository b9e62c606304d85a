"""Mixing sources to target weights with exponential keys, in DataFrame functions only.

Every row draws ``-ln(u) / quality`` with a u keyed by its content and a seed (Efraimidis and
Spirakis): taking a source in the order of these keys is weighted sampling without
replacement.  A source first gives as many complete epochs as its target holds, then the rows
at the front of the order whose running size stays within the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runwatch import runtime

from . import shared

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SEED = 20
#: characters that are neither letters, digits nor white space; many of them mark junk
_MARKS = "[^\\p{L}\\p{N}\\s]"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """1 for a text without marks, less the more marks it has for each word; never 0."""
    marks = F.coalesce(F.regexp_count(text, F.lit(_MARKS)), F.lit(0))
    return 1.0 / (1.0 + marks / F.greatest(size_of(text), F.lit(1)))


def _measured(docs: DataFrame, quality: Column | None, seed: int, keep: list[Column]) -> DataFrame:
    """``keep`` with ``_size``, ``_key``, ``_tie`` and the source split into a flag and a name.

    One projection of ``docs``, so that none of its columns can clash with these.
    """
    weight = quality_of(F.col("text")) if quality is None else F.greatest(quality, F.lit(1e-9))
    tie = F.xxhash64(F.lit(seed), "doc_id", "text")
    u = (F.shiftrightunsigned(F.xxhash64(tie), 11) + 0.5) / float(1 << 53)
    return docs.select(
        *keep, size_of(F.col("text")).alias("_size"), (-F.log(u) / weight).alias("_key"), tie.alias("_tie"),
        F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_name"))


def _targets(rows: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """One row per source: ``_rank, source_size, target``.  Windows run over sources, not rows.

    A source is full at ``most * size``.  In the order of full / weight, the level of the rest
    is what the full ones leave, shared by weight; the first level that fills no more is it.
    """
    sums = rows.groupBy("_null", "_name").agg(F.sum("_size").alias("source_size"))
    sums = runtime.materialise(sums)
    rank = F.row_number().over(Window.orderBy("_null", "_name"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank - 1, F.lit(len(weights))).cast("int") + 1)
    named = sums.withColumn("_rank", rank).withColumn("_weight", weight).withColumn(
        "_full", F.col("source_size") * float(most))
    line = Window.orderBy(F.col("_full") / F.col("_weight"), "_rank")
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    done = F.coalesce(F.sum("_full").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_weight").over(line.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) - done) / open_weight
    named = named.withColumn("_level", level)
    fits = F.when(F.col("_level") * F.col("_weight") <= F.col("_full") * (1 + 1e-12), F.col("_level"))
    named = named.withColumn("_level", F.first(fits, ignorenulls=True).over(
        line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return named.select("_null", "_name", "_rank", "source_size",
                        F.least("_full", F.col("_level") * F.col("_weight")).alias("target"))


def _plan(docs: DataFrame, weights, most, quality, seed) -> tuple[DataFrame, DataFrame]:
    """Measured narrow rows, and per source its epochs and where the fraction ends.

    Rows that agree in id and text share key and tie; ``_n`` numbers all rows, so that a source
    may be cut between equal ones.  ``_last`` is the last row of the fraction, ``_of_last`` how
    many rows with its key and tie the fraction holds.
    """
    rows = shared.stored(_measured(docs, quality, seed, [F.col("doc_id")]).withColumn(
        "_n", F.monotonically_increasing_id()))
    targets = runtime.materialise(_targets(rows, weights, most))
    ranked = runtime.attach(rows, targets, ["_null", "_name"], row_bytes=128)
    order = ["_key", "_tie", "_n"]
    before = shared.prefix_sums(
        ranked.select("_rank", *order, "_size"), "_rank", [F.col(c) for c in order], "_size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    wanted = targets.withColumn("_epochs", F.least(epochs, F.lit(most)).cast("int")).withColumn(
        "_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    chosen = runtime.attach(before, wanted.select("_rank", "_rest"), ["_rank"], rows=targets.count())
    # the row that crosses the budget is taken if that comes nearer to it
    chosen = shared.stored(chosen.where(
        2 * F.col("before") + F.col("_size") <= 2 * F.col("_rest")).select("_rank", *order))
    last = runtime.materialise(chosen.groupBy("_rank").agg(F.max(F.struct(*order)).alias("_last")))
    same = (F.col("_key") == F.col("_last._key")) & (F.col("_tie") == F.col("_last._tie"))
    of_last = runtime.attach(chosen, last, ["_rank"]).groupBy("_rank").agg(F.count_if(same).alias("_of_last"))
    return rows, runtime.materialise(wanted.join(last, "_rank", "left").join(of_last, "_rank", "left"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_EPOCHS,
        quality: Column | None = None, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs (doc_id, text, source)``.

    Sources in code point order (NULL last, its own source) take the weights in turn.  A NULL or
    empty text has size 0.  Rows that agree in id and text are interchangeable: as many of them
    are taken as the target asks for, and reruns agree.  Sources without words get target 0.  An
    empty table gives an empty result; further columns are not read.
    """
    docs = docs.select("doc_id", "text", "source")
    rows, plan = _plan(docs, weights, most, quality, seed)
    out = runtime.attach(rows, plan, ["_null", "_name"], row_bytes=192)
    inside = F.coalesce(F.struct("_key", "_tie", "_n") <= F.col("_last"), F.lit(False))
    return out.select(
        "doc_id", F.col("_size").alias("size"), "source_size", F.col("target").cast("double").alias("target"),
        (F.col("_size") * (F.col("_epochs") + inside.cast("int"))).cast("long").alias("taken"))


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_EPOCHS,
            quality: Column | None = None, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns kept, each as often as it is taken.

    Whether a row is in the fraction is a comparison with its source's last key, so the texts
    are not shuffled; only rows equal to that last one are numbered.  NULL ids, texts and sources,
    repeated rows and columns of any name are kept as they are; an empty table stays empty.
    """
    _, plan = _plan(docs.select("doc_id", "text", "source"), weights, most, quality, seed)
    end = plan.select("_null", "_name", "_rank", "_epochs", "_last", "_of_last")
    whole = runtime.attach(_measured(docs, quality, seed, [F.struct("*").alias("_row")]), end,
                           ["_null", "_name"], row_bytes=192)
    here, there = F.struct("_key", "_tie"), F.struct("_last._key", "_last._tie")
    at_end = F.coalesce(here == there, F.lit(False))
    clear = whole.where(~at_end).withColumn(
        "_copies", F.col("_epochs") + F.coalesce(here < there, F.lit(False)).cast("int"))
    kept = ["_row", "_copies"]
    edge = _numbered(whole.where(at_end).select("_row", "_rank", "_epochs", "_of_last")).withColumn(
        "_copies", F.col("_epochs") + (F.col("_number") <= F.col("_of_last")).cast("int"))
    every = clear.select(*kept).unionByName(edge.select(*kept)).where("_copies > 0")
    return every.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_number``, from 1 within ``_rank``; no task holds more than an input partition's rows."""
    parts = shared.stored(rows.withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_rank", "_part").agg(F.count(F.lit(1)).alias("_count"))
    earlier = Window.partitionBy("_rank").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runtime.materialise(counts.withColumn(
        "_before", F.coalesce(F.sum("_count").over(earlier), F.lit(0))).drop("_count"))
    local = F.row_number().over(Window.partitionBy("_rank", "_part").orderBy(F.lit(0)))
    joined = runtime.attach(parts.withColumn("_local", local), offsets, ["_rank", "_part"], row_bytes=64)
    return joined.withColumn("_number", F.col("_before") + F.col("_local"))
