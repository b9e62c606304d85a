"""Exact grouped quantiles that never gather a large group in one task.

Groups up to ``EXACT_ROWS`` rows use the built-in ``percentile`` aggregate (its
state is a value histogram, so it is bounded by that count).  Larger groups are
narrowed instead.  A mergeable sketch of every group proposes bounds close to
each wanted rank; one exact count of the rows between the bounds tells where the
ranks really lie, and what lies elsewhere is never looked at again.  A row falls
between one pair of bounds, so it is counted once a pass however many ranks are
wanted.  The scan that counts also stores the distinct values next to the wanted
ranks, a few thousandths of the rows a rank, and later passes read those alone.
Brackets of at most ``FINISH_ROWS`` values are sorted.  The sketch only decides
how fast a bracket shrinks; the counts are exact, and so is the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import with_count
from ..runtime import attach, materialise, stored

EXACT_ROWS = 500_000
FINISH_ROWS = 250_000
#: size of a sketch, and how far from a rank its bounds lie, as a share of the rows
SKETCH_SIZE = 4096
MARGIN = 0.0015
#: quantiles read off a sketch
LEVELS = 2000
#: further bounds where rows stand for several rows each, so that a pass still divides them
GRID = [k / 16 for k in range(1, 16)]
#: a pass leaves a bracket a few thousandths of its rows
MAX_PASSES = 60


def _interpolate(lo: Column, hi: Column, pos: Column) -> Column:
    below, above = F.floor(pos).cast("double"), F.ceil(pos).cast("double")
    mix = (above - pos) * lo + (pos - below) * hi
    return F.when((below == above) | (lo == hi), lo).otherwise(mix)


def grouped_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: list[float],
    counts: DataFrame | None = None,
    exact_rows: int | None = None,
    weight: str | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per group.

    Returns ``keys, n, q`` with ``q ARRAY<DOUBLE>`` aligned with ``probs``.  NULLs
    are skipped.  ``weight`` is an integer column: how many equal rows a row
    stands for.  ``counts`` (``keys, n``) saves the counting scan when the caller
    already knows the non-NULL count of every group, ``largest`` (an upper bound
    of it) also the look at the counts.
    """
    exact_rows = EXACT_ROWS if exact_rows is None else exact_rows
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("_v"), times.alias("_c"))
    if largest is not None and largest <= exact_rows:
        return _builtin(rows, keys, probs, weight is not None)
    if counts is None:
        counts = materialise(rows.groupBy(*keys).agg(F.sum("_c").alias("n")))
    # beside groups that are narrowed anyway, others are held whole only where they are no more than is sorted
    bound = min(exact_rows, FINISH_ROWS)
    largest, n_small = counts.agg(F.max("n"), F.count_if(F.col("n") <= bound)).first()
    if (largest or 0) <= exact_rows:
        return _builtin(rows, keys, probs, weight is not None)
    far = _narrowed(rows, keys, probs, counts.where(F.col("n") > bound), largest)
    if not n_small:
        return far
    small = counts.where(F.col("n") <= bound).select(*keys)
    return _builtin(attach(rows, small, keys, rows=n_small), keys, probs, weight is not None).unionByName(far)


def _builtin(rows: DataFrame, keys: list[str], probs: list[float], weighted: bool) -> DataFrame:
    fractions = F.array(*[F.lit(float(p)) for p in probs])
    times = F.col("_c") if weighted else 1
    return rows.groupBy(*keys).agg(
        F.sum("_c").alias("n"), F.percentile("_v", fractions, times).alias("q")
    )


def _narrowed(
    rows: DataFrame, keys: list[str], probs: list[float], large: DataFrame, largest: int
) -> DataFrame:
    wanted = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
                  for i, p in enumerate(probs)])
    )
    at = large.withColumn("w", wanted).select(
        *keys, "n", F.col("w.i").alias("i"), (F.col("w.p") * (F.col("n") - 1)).alias("pos")
    )
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return order_values(rows, keys, at, largest).groupBy(*keys, "n").agg(
        F.transform(ordered, lambda s: s["x"]).alias("q")
    )


def order_values(
    rows: DataFrame, keys: list[str], wanted: DataFrame, largest: int | None = None
) -> DataFrame:
    """Values at fractional 0-based positions: ``wanted`` is ``keys, n, i, pos``.

    ``rows`` is ``keys, _v, _c`` without NULLs (``_c``: rows it stands for).  Returns
    ``keys, n, i, x, below, ties``: at a whole position ``below`` rows are smaller than x and
    ``ties`` equal to it.  ``largest`` bounds the group sizes where the caller knows them.
    """
    mark = F.struct("i", "n", F.floor("pos").alias("a"), F.ceil("pos").alias("b"), "pos")
    nothing = F.lit(None).cast("double")
    state = wanted.groupBy(*keys).agg(F.collect_list(mark).alias("_marks"), F.max("n").alias("_inside"))
    state = state.select(*keys, nothing.alias("_lo"), nothing.alias("_hi"),
                         F.lit(0).cast("bigint").alias("_below"), "_inside", "_marks")
    if largest is not None and largest <= FINISH_ROWS:
        return _finish(rows, keys, state, whole=True)
    state = materialise(state.withColumn("_stored", F.lit(True)))
    small = F.col("_inside") <= FINISH_ROWS
    found, source, near, whole = [], rows, rows, True
    for _ in range(MAX_PASSES):
        n_small, n_open, n_missed = state.agg(
            F.count_if(small), F.count_if(~small), F.count_if(~F.col("_stored"))).first()
        # what lies between the bounds of a mark is stored; only where a sketch was off look at all rows again
        source = source if n_missed else near
        if n_small or not (n_open or found):
            found.append(_finish(source, keys, state.where(small), whole))
        if not n_open:
            break
        slots, near = _count_between(source, keys, state.where(~small), whole, n_open)
        found.append(_settled(slots, keys))
        state, whole = _still_open(slots, keys), False
    else:
        raise RuntimeError(f"a quantile was not found in {MAX_PASSES} passes")
    return reduce(DataFrame.unionByName, found)


def _placed(
    rows: DataFrame, keys: list[str], brackets: DataFrame, whole: bool, n_brackets: int | None = None
) -> DataFrame:
    """Rows that lie in a bracket of their group, with its lower bound (brackets do not overlap)."""
    if whole:
        nothing = F.lit(None).cast("double")
        return attach(rows, brackets.select(*keys), keys, rows=n_brackets).withColumn("_lo", nothing)
    lists = materialise(
        brackets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_lo", "_hi"))).alias("_in"))
        .select(*keys, F.col("_in._lo").alias("_los"), F.col("_in._hi").alias("_his")))
    n_lists, longest = _extent(lists, "_los")
    near = with_count(attach(rows, lists, keys, row_bytes=1024, rows=n_lists), "_at", "_los", "_v", longest)
    own = lambda ends: F.get(ends, F.col("_at") - 1)
    return near.where(F.col("_v") <= own("_his")).select(*rows.columns, own("_los").alias("_lo"))


def _extent(table: DataFrame, name: str) -> tuple[int, int]:
    """Rows of a reduced table and the length of its longest array ``name``."""
    rows, longest = table.agg(F.count(F.lit(1)), F.max(F.size(name))).first()
    return rows, longest or 0


def _count_between(
    rows: DataFrame, keys: list[str], active: DataFrame, whole: bool, n_active: int
) -> tuple[DataFrame, DataFrame]:
    """One pass over open brackets: a sketch each, then exact counts between the bounds it gives.

    One row for each stretch between bounds: ``_weight`` rows (``_rows`` table rows) from ``_min``
    to ``_max``, of which ``_before`` precede in the group, the following stretch's ``_next``, and
    the marks whose lower position lies in it.  Also ``keys, _v, _c`` of the stretches between the two
    bounds of a mark (``_stored``), equal rows as one, taken down by the scan that counts.
    """
    held = _placed(rows, keys, active, whole, n_active)
    cell = [*keys, "_lo"]
    same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"a.`{k}`")) for k in cell]
    sketch = held.groupBy(*cell).agg(
        F.kll_sketch_agg_double("_v", SKETCH_SIZE).alias("_sketch"),
        F.bool_or(F.col("_c") != 1).alias("_weighted"))
    joined = sketch.alias("r").join(active.alias("a"), same).select(
        "a.*", "r._sketch", "r._weighted").drop("_stored")
    levels = F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(k / LEVELS) for k in range(LEVELS + 1)]))
    place = lambda m, rank: (m[rank] - F.col("_below")) / F.col("_inside")
    level = lambda x: F.get("_levels", F.greatest(F.lit(0), F.least(F.lit(LEVELS), x)).cast("int"))
    grid = F.when(F.col("_weighted"), F.transform(F.array(*[F.lit(g) for g in GRID]), lambda g: level(g * LEVELS)))
    around = F.transform("_marks", lambda m: F.struct(
        level(F.floor((place(m, "a") - MARGIN) * LEVELS)).alias("lo"),
        level(F.ceil((place(m, "b") + MARGIN) * LEVELS)).alias("hi")))
    ends = F.concat("_around.lo", "_around.hi", F.coalesce(grid, F.array().cast("array<double>")))
    wanted = F.transform("_bounds", lambda v, i: F.exists(
        "_around", lambda e: (e["lo"] <= v) & F.coalesce(F.get("_bounds", i + 1) <= e["hi"], F.lit(False))))
    bounds = materialise(
        joined.withColumn("_levels", levels).withColumn("_around", around)
        .withColumn("_bounds", F.array_sort(F.array_distinct(ends)))
        .select(*keys, "_lo", "_below", "_marks", "_bounds", wanted.alias("_wanted")))
    n_bounds, longest = _extent(bounds, "_bounds")
    if whole:
        tagged = attach(rows, bounds.select(*keys, "_bounds", "_wanted"), keys, row_bytes=1024, rows=n_bounds)
        tagged = tagged.withColumn("_lo", F.lit(None).cast("double"))
    else:
        tagged = attach(held, bounds.select(*keys, "_lo", "_bounds", "_wanted"), cell, row_bytes=1024, rows=n_bounds)
    # values equal to a bound have a stretch of their own, so that a frequent value stands alone
    tagged = with_count(tagged, "_at", "_bounds", "_v", longest)
    equal = F.coalesce(F.get("_bounds", F.col("_at") - 1) == F.col("_v"), F.lit(False))
    near = ~equal & F.coalesce(F.get("_wanted", F.col("_at") - 1), F.lit(False))
    values = stored(
        tagged.groupBy(*cell, (2 * F.col("_at") - equal.cast("int")).alias("_slot"),
                       near.alias("_stored"), F.when(near, F.col("_v")).alias("_value"))
        .agg(F.sum("_c").alias("_weight"), F.count(F.lit(1)).alias("_rows"),
             F.min("_v").alias("_min"), F.max("_v").alias("_max")))
    held_rows = F.when(F.col("_stored"), F.lit(1).cast("bigint")).otherwise(F.col("_rows"))
    counted = values.groupBy(*cell, "_slot", "_stored").agg(
        F.sum("_weight").alias("_weight"), F.sum(held_rows).alias("_rows"),
        F.min("_min").alias("_min"), F.max("_max").alias("_max"))
    known = counted.alias("r").join(bounds.drop("_bounds").alias("a"), same).select(
        "r.*", "a._below", "a._marks")
    line = Window.partitionBy(*cell).orderBy("_slot")
    ended = known.withColumns({
        "_end": F.col("_below") + F.sum("_weight").over(line.rowsBetween(Window.unboundedPreceding, 0)),
        "_next": F.lead("_min").over(line)})
    before = F.col("_end") - F.col("_weight")
    slots = ended.withColumn("_before", before).withColumn("_marks", F.filter(
        "_marks", lambda m: (m["a"] >= F.col("_before")) & (m["a"] < F.col("_end")))).where(F.size("_marks") > 0)
    return materialise(slots), values.where("_stored").select(
        *keys, F.col("_value").alias("_v"), F.col("_weight").alias("_c"))


def _settled(slots: DataFrame, keys: list[str]) -> DataFrame:
    """Marks whose two positions lie in different stretches, or in one of a single value."""
    each = slots.withColumn("m", F.explode("_marks"))
    crossing = F.col("m.b") >= F.col("_end")
    flat = F.col("_min") == F.col("_max")
    x = _interpolate(F.col("_max"), F.when(crossing, F.col("_next")).otherwise(F.col("_max")), F.col("m.pos"))
    return each.where(crossing | flat).select(
        *keys, "m.n", "m.i", x.alias("x"), F.when(flat, F.col("_before")).alias("below"),
        F.when(flat, F.col("_weight")).alias("ties"))


def _still_open(slots: DataFrame, keys: list[str]) -> DataFrame:
    left = F.filter("_marks", lambda m: m["b"] < F.col("_end"))
    return slots.where(F.col("_min") < F.col("_max")).select(
        *keys, F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), F.col("_before").alias("_below"),
        F.col("_rows").alias("_inside"), left.alias("_marks"), "_stored").where(F.size("_marks") > 0)


def _finish(rows: DataFrame, keys: list[str], brackets: DataFrame, whole: bool = False) -> DataFrame:
    """Sort the values of small brackets and read the marks off their running counts."""
    cell = [*keys, "_lo"]
    same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"a.`{k}`")) for k in cell]
    values = _placed(rows, keys, brackets, whole).groupBy(*cell, "_v").agg(F.sum("_c").alias("_c"))
    known = values.alias("r").join(brackets.alias("a"), same).select("r.*", "a._below", "a._marks")
    line = Window.partitionBy(*cell).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_below") + F.sum("_c").over(line)
    here = lambda rank: (rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end"))
    hit = known.withColumn("_end", end).withColumn(
        "m", F.explode(F.filter("_marks", lambda m: here(m["a"]) | here(m["b"]))))
    return hit.groupBy(*keys, "m.n", "m.i", "m.pos").agg(
        F.min("_v").alias("_a"), F.max("_v").alias("_b"),
        F.min(F.col("_end") - F.col("_c")).alias("below"), F.min_by("_c", "_v").alias("ties"),
    ).select(*keys, "n", "i", _interpolate(F.col("_a"), F.col("_b"), F.col("pos")).alias("x"), "below", "ties")


def spread_fractions(bin_counts: list[int]) -> tuple[list[float], dict[int, int]]:
    """Edge fractions of every bin count, laid end to end, and where each starts."""
    fractions: list[float] = []
    start: dict[int, int] = {}
    for nb in sorted(set(bin_counts)):
        start[nb] = len(fractions)
        fractions.extend(i * (1.0 / nb) for i in range(nb))
        fractions.append(1.0)
    return fractions, start
