"""Minimum covariance determinant (Rousseeuw & Van Driessen 1999) on all rows.

Starts are searched in parts of bounded size that together hold every row of a
group, as in the nested scheme of the paper.  The best ``CANDIDATES`` of them take
``TRIAL_STEPS`` concentration steps over the whole data side by side, so what wins in
one part need not win; the best of them then goes on until it settles.  A step is
distances, the exact h-th smallest one, and the Gram sums of the rows within it: one
scan counts the rows of every model by the leading bits of their distance, one more adds
up the rows below the slot of the wanted rank and hands on those in it (``concentrate``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_quantile
from ..runtime import attach, materialise, stored
from .blocks import Pairs, matrix, meet
from .distance import distances
from .gram import gram, pack, per_row, unpack
from .quantiles import FINISH_ROWS, order_values

#: rows of a part in which starts are searched
PART_ROWS = 1500
STARTS = 30
#: starts that are tried on the whole data, for how many steps, and out of how many at most
CANDIDATES, TRIAL_STEPS, POOL = 10, 2, 64
#: a group that still moves after so many steps is marked and gets a warning
MAX_STEPS = 40
#: a step that lowers the log determinant by less than this has settled
MIN_GAIN = 1e-3

#: slots of distances for each doubling, and the slot of a distance of zero
SLOTS, NO_DISTANCE = 512, -(1 << 30)

#: low bits of a distance that each counting pass leaves out; the last slots hold one value
SHIFTS = (43, 30, 17, 4, 0)
#: slots, and cells of sums, that a task holds before it hands them on
HELD_SLOTS, HELD_CELLS = 1 << 20, 1 << 22

_STATE = ("op string, chain string, use array<boolean>, shift array<double>, "
          "weight array<double>, cov array<double>, logdet double, singular boolean")


def _state(op: str, chain: str, use: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> dict:
    """Model row for the distance operator; the pseudo-root copes with flat directions."""
    pick = np.flatnonzero(use)
    val, vec = np.linalg.eigh(cov[np.ix_(pick, pick)])
    good = val > 1e-12 * max(val.max(), 1e-300)
    p = len(use)
    weight = np.zeros((p, p))
    weight[np.ix_(np.arange(int(good.sum())), pick)] = (vec[:, good] / np.sqrt(val[good])).T
    logdet = float(np.log(val[good]).sum()) if good.all() else float("-inf")
    return {
        "op": op, "chain": chain, "use": use.tolist(), "shift": mean.tolist(),
        "weight": weight.ravel().tolist(), "cov": cov.ravel().tolist(),
        "logdet": logdet, "singular": not bool(good.all()),
    }


def _support(n: int, p: int, fraction: float | None) -> int:
    h = int(np.ceil(0.5 * (n + p + 1))) if fraction is None else int(fraction * n)
    return min(max(h, 2), n)


def _concentrate(z: np.ndarray, picks: np.ndarray, h: int, steps: int) -> tuple:
    """Up to ``steps`` concentration steps in memory from each row of ``picks`` (row numbers of its subset).

    All starts step side by side: (logdets, means, covs, rows kept).
    """
    p = z.shape[1]

    def fits(picks: np.ndarray) -> tuple:
        part = z[picks]
        mean = part.mean(axis=1)
        gap = part - mean[:, None]
        cov = gap.transpose(0, 2, 1) @ gap / picks.shape[1]
        sign, logdet = np.linalg.slogdet(cov)
        return mean, cov, np.where(sign > 0, logdet, np.inf)

    # subsets of two sizes stand side by side: those that have taken a step hold h rows
    kept = np.zeros((len(picks), h), dtype=np.int64)
    mean, cov, logdet = fits(picks)
    last = np.full(len(picks), np.inf)
    moving = np.arange(len(picks))
    if picks.shape[1] == h:
        kept[:] = picks
    for k in range(steps):
        if k or picks.shape[1] >= h:
            with np.errstate(invalid="ignore"):
                settled = np.isfinite(logdet[moving]) & (last[moving] - logdet[moving] < 1e-9)
            last[moving] = logdet[moving]
            moving = moving[~settled]
        if not len(moving):
            break
        gap = z[None] - mean[moving, None]
        d2 = (gap @ np.linalg.pinv(cov[moving]) * gap).sum(axis=2)
        kept[moving] = np.argpartition(d2, h - 1, axis=1)[:, :h]
        mean[moving], cov[moving], logdet[moving] = fits(kept[moving])
    return logdet, mean, cov, kept


def _best_starts(z: np.ndarray, fraction: float | None, seed: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Short searches from random small subsets; the best ``k`` are run to their end."""
    n, p = z.shape
    h = _support(n, p, fraction)
    rng = np.random.default_rng(seed)
    tries = np.stack([rng.choice(n, size=min(p + 1, n), replace=False) for _ in range(STARTS)])
    logdet, _, _, kept = _concentrate(z, tries, h, 4)
    _, mean, cov, _ = _concentrate(z, kept[np.argsort(logdet, kind="stable")[:k]], h, 200)
    return [*zip(mean, cov)]


def nth_distances(d: DataFrame, ranks: DataFrame, n_models: int) -> DataFrame | None:
    """``op, chain, _cut``: the ``h``-th smallest ``d2`` of each model; ``ranks`` is ``op, h``.

    One scan counts the rows by the logarithm of their distance, which tells the slot of the wanted
    rank, and one more sorts the distances in that slot.  None when a slot holds more than
    ``FINISH_ROWS`` rows.
    """
    model = ["op", "chain"]
    slot = F.floor(F.log2("d2") * F.lit(SLOTS))
    near = d.where(F.col("d2").isNotNull()).select(
        *model, "d2", F.coalesce(slot, F.lit(NO_DISTANCE)).alias("_slot"))
    line = Window.partitionBy(*model).rowsBetween(Window.unboundedPreceding, 0)

    def reached(counted: DataFrame, by: str) -> DataFrame:
        end = F.sum("_c").over(line.orderBy(by))
        return counted.withColumn("_before", end - F.col("_c")).where(
            (F.col("_before") < F.col("h")) & (F.col("_before") + F.col("_c") >= F.col("h")))

    slots = near.groupBy(*model, "_slot").agg(F.count(F.lit(1)).alias("_c"))
    held = materialise(reached(attach(slots, ranks, ["op"], rows=n_models), "_slot").select(
        *model, "_slot", (F.col("h") - F.col("_before")).alias("h"), F.col("_c").alias("_inside")))
    if (held.agg(F.max("_inside")).first()[0] or 0) > FINISH_ROWS:
        return None
    inside = attach(near, held.drop("_inside"), [*model, "_slot"], rows=n_models)
    values = inside.groupBy(*model, "h", "d2").agg(F.count(F.lit(1)).alias("_c"))
    return materialise(reached(values, "d2").select(*model, F.col("d2").alias("_cut")))


def _squared(z: np.ndarray, model: dict) -> np.ndarray:
    """Squared distances of the rows of ``z``; equal rows have equal ones, wherever in a batch they are."""
    p = z.shape[1]
    weight, gap = model["weight"].reshape(p, p), np.where(model["use"], z - model["shift"], 0.0).T.copy()
    total = np.zeros(len(z))
    for k in range(p):
        y = np.zeros(len(z))
        for j in np.flatnonzero(weight[k]):
            y += weight[k, j] * gap[j]
        total += y * y
    return total


def _complete(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    z = matrix(batch, columns)
    return z[~np.isnan(z).any(axis=1)]


def _slot_counter(columns: list[str], before: int | None, shift: int):
    """``op, chain, _slot, _c``: rows by the bits of their distance above ``shift``, inside the last pass's slot."""

    def work(pairs: Pairs) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def added() -> int:
            for key, parts in held.items():
                slots, at = np.unique(np.concatenate([s for s, _ in parts]), return_inverse=True)
                held[key] = [(slots, np.bincount(at, np.concatenate([c for _, c in parts]), len(slots)))]
            return sum(len(parts[0][0]) for parts in held.values())

        def batches() -> Iterator[pa.RecordBatch]:
            added()
            for (op, chain), ((slots, counts),) in held.items():
                n = len(slots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([op] * n, pa.string()), pa.array([chain] * n, pa.string()), pa.array(slots),
                     pa.array(counts.astype(np.int64))], ["op", "chain", "_slot", "_c"])
            held.clear()

        for (op,), models, batch in pairs:
            z = _complete(batch, columns)
            for model in models:
                bits = _squared(z, model).view(np.int64)
                if before is not None:
                    bits = bits[bits >> before == model["_head"]]
                held.setdefault((op, model["chain"]), []).append((bits >> shift, np.ones(len(bits))))
                size += len(bits)
            if size > HELD_SLOTS:
                size = added()
                if size > HELD_SLOTS // 2:
                    yield from batches()
                    size = 0
        yield from batches()

    return work


def _slot_sums(columns: list[str], shift: int):
    """``op, chain, d2, cells``: packed sums of the rows below the slot (no ``d2``) and the rows inside it."""

    def work(pairs: Pairs) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        cells = pa.list_(pa.float64())

        def batch_of(keys: list[tuple], d2: list, rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                 pa.array(d2, pa.float64()), pa.array(rows, cells)], ["op", "chain", "d2", "cells"])

        for (op,), models, batch in pairs:
            z = _complete(batch, columns)
            for model in models:
                key, d2 = (op, model["chain"]), _squared(z, model)
                slot = d2.view(np.int64) >> shift
                # a slot of one value lies within the cut as a whole
                below, inside = (slot < model["_head"], slot == model["_head"]) if shift else (
                    slot <= model["_head"], np.zeros(len(z), bool))
                held[key] = held.get(key, 0.0) + pack(z[below], False)
                if inside.any():
                    yield batch_of([key] * int(inside.sum()), d2[inside].tolist(), list(z[inside]))
            if held and len(held) * len(next(iter(held.values()))) > HELD_CELLS:
                yield batch_of(list(held), [None] * len(held), list(held.values()))
                held = {}
        if held:
            yield batch_of(list(held), [None] * len(held), list(held.values()))

    return work


def concentrate(
    rows: DataFrame, current: DataFrame, ranks: DataFrame, columns: list[str], n_models: int,
    finish_rows: int = FINISH_ROWS,
) -> DataFrame:
    """The states after one concentration step of every model; ``ranks`` is ``op, h``.

    The rows of a model are counted by the leading bits of their distance, by more of them while the
    slot of the ``h``-th smallest holds more than ``finish_rows`` rows.  One scan then adds up the rows
    below the slot; the rows inside it are sorted.  Rows as far as the ``h``-th belong to the subset.
    """
    p = len(columns)
    model, size = ["op", "chain"], 8 * p * (p + 2) + 256
    line = Window.partitionBy(*model).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    models = current.select(*model, "use", "shift", "weight")
    facts, left, before = models, ranks.select("op", F.col("h").alias("_left")), None
    for shift in SHIFTS:
        counted = meet(rows, facts, ["op"], _slot_counter(columns, before, shift),
                       "op string, chain string, _slot bigint, _c bigint", size, n_models)
        by_slot = counted.groupBy(*model, "_slot").agg(F.sum("_c").alias("_c"))
        ended = attach(by_slot, left, ["op"] if before is None else model, rows=n_models).withColumn(
            "_end", F.sum("_c").over(line))
        under = F.col("_end") - F.col("_c")
        held = materialise(ended.where((under < F.col("_left")) & (F.col("_end") >= F.col("_left"))).select(
            *model, F.col("_slot").alias("_head"), (F.col("_left") - under).alias("_left"), F.col("_c").alias("_inside")))
        facts, left, before = models.join(held, model), held.select(*model, "_left"), shift
        if (held.agg(F.max("_inside")).first()[0] or 0) <= finish_rows:
            break

    def finish(parts: pd.DataFrame, fact: pd.DataFrame) -> pd.DataFrame:
        if parts.empty or fact.empty:
            return pd.DataFrame(columns=["op", "chain", "use", "shift", "weight", "cov", "logdet", "singular"])
        fact, single = fact.iloc[0], parts["d2"].notna()
        acc = np.sum(np.stack(parts.loc[~single, "cells"].to_list()), axis=0)
        if single.any():
            d2, z = parts.loc[single, "d2"].to_numpy(), np.stack(parts.loc[single, "cells"].to_list())
            acc = acc + pack(z[d2 <= np.partition(d2, int(fact["_left"]) - 1)[int(fact["_left"]) - 1]], False)
        n, total, cross, _ = unpack(acc, p)
        mean = total / n
        return pd.DataFrame([_state(fact["op"], fact["chain"], np.asarray(fact["use"], bool), mean,
                                    cross / n - np.outer(mean, mean))])

    sums = meet(rows, facts, ["op"], _slot_sums(columns, before), "op string, chain string, d2 double, cells array<double>",
                size, n_models)
    return materialise(sums.groupBy(*model).cogroup(facts.select(*model, "use", "_left").groupBy(*model)).applyInPandas(
        finish, _STATE))


def minimum_covariance_determinant(
    z: DataFrame, sizes: DataFrame, columns: list[str], fraction: float | None, seed: int
) -> DataFrame:
    """``op, mcd_mean, mcd_cov, mcd_open`` over complete standardised rows ``op, run_id, columns``.

    ``sizes`` is ``op, n, use``.  Groups with no more rows than sensors are left
    out (the caller falls back to shrinkage).
    """
    p = len(columns)
    used = F.size(F.filter("use", lambda u: u))
    groups = materialise(sizes.where(F.col("n") > used).select(
        "op", "n", "use", used.alias("p"),
        F.when(F.lit(fraction is None), F.ceil((F.col("n") + used + 1) / F.lit(2.0)))
        .otherwise(F.floor(F.lit(fraction or 0.0) * F.col("n"))).cast("bigint").alias("h"),
    ))
    groups = groups.withColumn("h", F.least(F.greatest("h", F.lit(2)), "n"))
    known = groups.agg(F.count(F.lit(1)).alias("ops"), F.max("n").alias("largest")).first()
    ops, largest = known["ops"], known["largest"] or 0
    # every step reads these rows again: store them once
    rows = stored(attach(z, groups.select("op"), ["op"], rows=ops))

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        use = np.asarray(pdf["use"].iloc[0], dtype=bool)
        pick = np.flatnonzero(use)
        x = pdf.sort_values("run_id")[columns].to_numpy(dtype=float)[:, pick]
        part, each = int(pdf["_part"].iloc[0]), -(-CANDIDATES // int(pdf["_parts"].iloc[0]))
        found = []
        for j, (m, c) in enumerate(_best_starts(x, fraction, seed, each)):
            mean, cov = np.zeros(p), np.zeros((p, p))
            mean[pick], cov[np.ix_(pick, pick)] = m, c
            found.append(_state(pdf["op"].iloc[0], f"c{(part * each + j) % POOL}", use, mean, cov))
        return pd.DataFrame(found)

    facts = groups.select("op", "use", F.ceil(F.col("n") / PART_ROWS).alias("_parts"))
    parted = attach(rows, facts, ["op"], rows=ops).withColumn(
        "_part", F.pmod(F.xxhash64("run_id", F.lit(f"mcd{seed}")), F.col("_parts")))
    tries = parted.groupBy("op", "_part").applyInPandas(start, _STATE)

    def lowest(states: DataFrame, keys: list[str]) -> DataFrame:
        best = F.min_by(F.struct(*states.columns), F.struct("singular", "logdet", "shift"))
        return states.groupBy(*keys).agg(best.alias("_best")).select("_best.*").select(*states.columns)

    # one start for each place of the pool, then the best of the pool
    line = Window.partitionBy("op").orderBy("singular", "logdet", "shift")
    state = materialise(lowest(tries, ["op", "chain"]).withColumn("_r", F.row_number().over(line)).where(
        F.col("_r") <= CANDIDATES).drop("_r"))

    def refit(rows_in: DataFrame, before: DataFrame) -> DataFrame:
        sums = gram(rows_in, ["op", "chain"], columns)

        def step(row: dict) -> dict:
            n, total, cross, _ = unpack(row["acc"], p)
            mean = total / n
            return _state(row["op"], row["chain"], np.asarray(row["use"], bool), mean,
                          cross / n - np.outer(mean, mean))

        return materialise(per_row(before.select("op", "chain", "use").join(sums, ["op", "chain"]), step, _STATE))

    def scored(current: DataFrame) -> DataFrame:
        return distances(rows, current, columns, ["chain"], rows=(ops or 0) * CANDIDATES)

    def value_at(d: DataFrame, current: DataFrame, pos: Column, name: str) -> DataFrame:
        v = d.select("op", "chain", F.col("d2").alias("_v"), F.lit(1).cast("bigint").alias("_c"))
        place = groups.join(current.select("op", "chain"), "op").select(
            "op", "chain", "n", F.lit(0).alias("i"), pos.cast("double").alias("pos"))
        return materialise(order_values(v, ["op", "chain"], place, largest).select(
            "op", "chain", F.col("x").alias(name)))

    def concentrated(current: DataFrame) -> DataFrame:
        # a group has few candidates, so there are no more models than these
        return concentrate(rows, current, groups.select("op", "h"), columns, (ops or 0) * CANDIDATES)

    for _ in range(TRIAL_STEPS):
        state = concentrated(state)
    state = materialise(lowest(state, ["op"]))
    for _ in range(MAX_STEPS):
        new = concentrated(state)
        moved = new.alias("a").join(state.alias("b"), "op").where(
            ~F.col("a.singular") & (F.col("a.logdet") < F.col("b.logdet") - MIN_GAIN))
        state, moving = new, moved.select("op")
        if moving.isEmpty():
            break
    settling = groups.select("op").join(
        materialise(moving).withColumn("mcd_open", F.lit(True)), "op", "left").select(
        "op", F.coalesce("mcd_open", F.lit(False)).alias("mcd_open"))

    # consistency at the normal distribution, then reweighting
    d = scored(state)
    middle = lambda way: nth_distances(
        d, groups.select("op", (way((F.col("n") - 1) / 2.0) + 1).alias("h")), ops or 0)
    low, high = middle(F.floor), middle(F.ceil)
    if low is None or high is None:
        med = value_at(d, state, (F.col("n") - 1) / 2.0, "_med")
    else:
        med = low.join(high.withColumnRenamed("_cut", "_high"), ["op", "chain"]).select(
            "op", "chain", F.when(F.col("_cut") == F.col("_high"), F.col("_cut")).otherwise(
                0.5 * F.col("_cut") + 0.5 * F.col("_high")).alias("_med"))
    ps = [r[0] for r in groups.select("p").distinct().collect()]
    pick = lambda q: F.create_map(
        *[x for k in ps for x in (F.lit(k), F.lit(chi2_quantile(q, k)))])[F.col("p")]
    if not ps:
        return groups.select("op").withColumns({
            "mcd_mean": F.lit(None).cast("array<double>"), "mcd_cov": F.lit(None).cast("array<double>"),
            "mcd_open": F.lit(False)})
    limit = materialise(groups.join(med, "op").select(
        "op", "chain", (F.col("_med") / pick(0.5) * pick(0.975)).alias("_cut")))
    final = refit(attach(d, limit, ["op", "chain"], rows=ops).where(F.col("d2") < F.col("_cut")), state)
    return final.join(settling, "op").select(
        "op", F.col("shift").alias("mcd_mean"), F.col("cov").alias("mcd_cov"), "mcd_open")
