"""Grouped logistic fits ``logit p = b0 + b1 ln x`` with a Poisson bootstrap.

The input is the sufficient statistic: per group and intensity, how many runs
and how many detected.  Groups with few distinct intensities (a checked count)
are fitted whole in one task each, all replicates as one matrix.  Larger groups
are fitted by distributed reweighted least squares: each iteration is one pass
that adds five sums per (group, replicate), as one vector per group and task.
Replicate weights come from a keyed hash of the cell, so both ways see the same
draws; replicates start at the fit of the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import attach, materialise, stored
from .blocks import Pairs, meet
from .gram import per_row
from .sums import Partials, key_fields, summed, vector_schema

#: most distinct intensities of a group that one task may hold
CELLS_PER_TASK = 20_000
# fixed values of the fit
MAX_ITER, TOL, RIDGE, ETA_LIMIT, WEIGHT_FLOOR = 100, 1e-9, 1e-8, 35.0, 1e-10


def _uniform(cell: np.ndarray, replicate: np.ndarray, stream: int) -> np.ndarray:
    """splitmix64 of (cell, replicate, stream) as uniforms in (0, 1)."""
    with np.errstate(over="ignore"):
        z = cell.astype(np.uint64)[:, None]
        step = (replicate.astype(np.uint64) * np.uint64(2) + np.uint64(stream))[None, :]
        z = z + step * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _poisson(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson quantile of every row of ``u`` at the row's integer mean."""
    out = np.zeros(u.shape)
    for m in np.unique(mean):
        if m <= 0:
            continue
        at = mean == m
        first = max(0, int(m - 12 * math.sqrt(m)))
        k = np.arange(first, int(m + 12 * math.sqrt(m)) + 20)
        logs = np.concatenate([[0.0], np.cumsum(math.log(m) - np.log(k[1:]))])
        mass = np.exp(logs - logs.max())
        cdf = np.cumsum(mass) / mass.sum()
        out[at] = k[np.minimum(np.searchsorted(cdf, u[at]), len(k) - 1)]
    return out


def replicate_weights(
    cell: np.ndarray, n: np.ndarray, k: np.ndarray, replicate: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(runs, detections) per cell and replicate; replicate 0 is the data itself.

    The sum of m Poisson(1) row weights is one Poisson(m) draw per cell.
    """
    hits = _poisson(k, _uniform(cell, replicate, 0))
    misses = _poisson(n - k, _uniform(cell, replicate, 1))
    itself = replicate == 0
    hits[:, itself] = k[:, None]
    misses[:, itself] = (n - k)[:, None]
    return hits + misses, hits


def step_sums(
    x: np.ndarray, runs: np.ndarray, hits: np.ndarray, beta: np.ndarray
) -> np.ndarray:
    """Five sums (w, wx, wxx, wz, wxz) per replicate; ``beta`` is replicates x 2."""
    eta = np.clip(beta[:, 0] + x[:, None] * beta[:, 1], -ETA_LIMIT, ETA_LIMIT)
    p = 1.0 / (1.0 + np.exp(-eta))
    w1 = np.maximum(p * (1.0 - p), WEIGHT_FLOOR)
    w = runs * w1
    wz = w * eta + (hits - runs * p)
    xs = x[:, None]
    return np.stack([w.sum(0), (w * xs).sum(0), (w * xs * xs).sum(0),
                     wz.sum(0), (wz * xs).sum(0)], axis=1)


def solve_step(sums: np.ndarray) -> np.ndarray:
    w, wx, wxx, wz, wxz = sums.T
    a, d = w + RIDGE, wxx + RIDGE
    det = a * d - wx * wx
    with np.errstate(all="ignore"):
        return np.stack([(d * wz - wx * wxz) / det, (a * wxz - wx * wz) / det], axis=1)


def advance(
    beta: np.ndarray, new: np.ndarray, open_: np.ndarray, converged: np.ndarray
) -> None:
    """Update the open fits in place and close those that converged or broke."""
    fine = np.isfinite(new).all(axis=1)
    with np.errstate(invalid="ignore"):
        close = fine & (np.abs(new - beta[open_]).max(axis=1) < TOL)
    at = np.flatnonzero(open_)
    beta[at[fine]] = new[fine]
    converged[at[close]] = True
    open_[at[close | ~fine]] = False


def fit_cells(
    x: np.ndarray, cell: np.ndarray, n: np.ndarray, k: np.ndarray, n_boot: int
) -> tuple[np.ndarray, np.ndarray]:
    """All replicates of one group: (beta, converged), row 0 being the data.

    The replicates start at the fit of the data, from which they are a few rounds away.
    """
    beta, ok = _iterate(x, n[:, None], k[:, None], np.zeros((1, 2)))
    if not n_boot:
        return beta, ok
    runs, hits = replicate_weights(cell, n, k, np.arange(1, n_boot + 1))
    more, fine = _iterate(x, runs, hits, np.repeat(_sound(beta), n_boot, axis=0))
    return np.concatenate([beta, more]), np.concatenate([ok, fine])


def _sound(beta: np.ndarray) -> np.ndarray:
    """A start for the replicates: the fit of the data, unless it ran away (perfect separation)."""
    return np.where(np.isfinite(beta).all(axis=1, keepdims=True) & (np.abs(beta) < 1e3).all(axis=1, keepdims=True), beta, 0.0)


def _iterate(
    x: np.ndarray, runs: np.ndarray, hits: np.ndarray, beta: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    converged, open_ = np.zeros(len(beta), dtype=bool), np.ones(len(beta), dtype=bool)
    for _ in range(MAX_ITER):
        new = solve_step(step_sums(x, runs[:, open_], hits[:, open_], beta[open_]))
        advance(beta, new, open_, converged)
        if not open_.any():
            break
    return beta, converged


def invert(b0: np.ndarray, b1: np.ndarray, target: float) -> np.ndarray:
    """Intensity where the fitted curve equals ``target``; NaN if it never rises to it."""
    with np.errstate(all="ignore"):
        log_i = (math.log(target / (1.0 - target)) - b0) / b1
        good = (b1 > 0) & np.isfinite(log_i) & (log_i <= 700.0)
        return np.where(good, np.exp(np.where(good, log_i, 0.0)), np.nan)


def _result(beta: np.ndarray, ok: np.ndarray, confidence: float) -> dict:
    """Fit of the data, the i90 of every replicate (None: not usable) and the bound they give."""
    boot = invert(beta[1:, 0], beta[1:, 1], 0.9)
    boot[~ok[1:]] = np.nan
    usable = boot[np.isfinite(boot)]
    b0, b1 = (float(v) if np.isfinite(v) else None for v in beta[0])
    bound = float(np.quantile(usable, confidence)) if len(usable) >= 20 else None
    return {"b0": b0, "b1": b1, "converged": bool(ok[0]), "n_usable": len(usable), "bound": bound,
            "boot_i90": [float(v) if np.isfinite(v) else None for v in boot]}


_FIT = "b0 double, b1 double, converged boolean, n_usable int, bound double, boot_i90 array<double>"


def fit_groups(
    cells: DataFrame, keys: list[str], n_boot: int = 200, confidence: float = 0.95,
    seed: object = 0, cells_per_task: int | None = None,
) -> DataFrame:
    """``keys, b0, b1, converged, n_usable, bound, boot_i90`` from materialised cells
    ``keys, intensity (> 0), n, k``; ``boot_i90`` has an entry for each replicate."""
    limit = CELLS_PER_TASK if cells_per_task is None else cells_per_task
    data = cells.select(
        *keys, F.ln("intensity").alias("x"), F.col("n").cast("double").alias("n"),
        F.col("k").cast("double").alias("k"),
        F.xxhash64(*[F.col(k).cast("string") for k in keys], "intensity", F.lit(str(seed)))
        .alias("cell"),
    )
    schema = ", ".join([*[f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys], _FIT])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "cell"])
        beta, ok = fit_cells(*(pdf[c].to_numpy() for c in ("x", "cell", "n", "k")), n_boot)
        head = {c: pdf[c].iloc[0] for c in keys}
        return pd.DataFrame([{**head, **_result(beta, ok, confidence)}])

    sizes = materialise(cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cells")))
    largest = sizes.agg(F.max("_cells")).first()[0] or 0
    if largest <= limit:
        return data.groupBy(*keys).applyInPandas(whole, schema)
    few = sizes.where(F.col("_cells") <= limit).select(*keys)
    many = materialise(sizes.where(F.col("_cells") > limit).select(*keys))
    near = attach(data, few, keys).groupBy(*keys).applyInPandas(whole, schema)
    return near.unionByName(_distributed(data, keys, many, n_boot, confidence, schema))


def _distributed(
    data: DataFrame, keys: list[str], groups: DataFrame, n_boot: int, confidence: float, schema: str
) -> DataFrame:
    """Fits of groups with any number of cells, first of the data and then of all replicates.

    The drawn weights of a cell are stored once, as one packed row.
    """
    mine = attach(data, groups, keys)
    itself = mine.select(*keys, "x", F.array("n").alias("runs"), F.array("k").alias("hits"))
    blank = lambda size: groups.select(
        *keys, F.array_repeat(F.lit(0.0), 2 * size).alias("beta"),
        F.array_repeat(F.lit(True), size).alias("open"), F.array_repeat(F.lit(False), size).alias("ok"))
    fits = _rounds(stored(itself), keys, materialise(blank(1)), 1)
    if n_boot:
        start = per_row(fits.select(*keys, "beta"), lambda row: {
            **{k: row[k] for k in keys},
            "beta": np.tile(_sound(np.asarray(row["beta"])[None, :])[0], n_boot).tolist(),
            "open": [True] * n_boot, "ok": [False] * n_boot}, blank(1).schema)
        more = _rounds(stored(_drawn(mine, keys, n_boot)), keys, materialise(start), n_boot)
        fits = fits.join(more.select(*keys, F.col("beta").alias("_beta"), F.col("ok").alias("_ok")), keys)
    else:
        none = F.array()
        fits = fits.withColumns({"_beta": none.cast("array<double>"), "_ok": none.cast("array<boolean>")})

    def conclude(row: dict) -> dict:
        beta = np.concatenate([row["beta"], row["_beta"]]).reshape(-1, 2)
        ok = np.concatenate([row["ok"], row["_ok"]]).astype(bool)
        return {**{k: row[k] for k in keys}, **_result(beta, ok, confidence)}

    return per_row(fits, conclude, schema)


def _drawn(cells: DataFrame, keys: list[str], n_boot: int) -> DataFrame:
    """``keys, x, runs, hits``: the weights of every cell in every replicate, as small whole numbers."""
    out = T.StructType([*[cells.schema[k] for k in keys], T.StructField("x", T.DoubleType()), *[
        T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("runs", "hits")]])
    replicates = np.arange(1, n_boot + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, n, k = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("cell", "n", "k"))
            ends = pa.array(np.arange(len(cell) + 1, dtype=np.int32) * n_boot)
            drawn = [pa.ListArray.from_arrays(ends, pa.array(w.astype(np.int32).ravel()))
                     for w in replicate_weights(cell, n, k, replicates)]
            at = [batch.column(batch.schema.get_field_index(c)) for c in [*keys, "x"]]
            yield pa.RecordBatch.from_arrays([*at, *drawn], out.fieldNames())

    return cells.mapInArrow(run, out)


def _rounds(cells: DataFrame, keys: list[str], state: DataFrame, size: int) -> DataFrame:
    """Reweighted least squares of ``size`` fits a group: a round is one pass over the cells.

    ``state`` is ``keys, beta, open, ok``; a pass adds five sums for every fit, a vector a group,
    and only whether anything is still open reaches the driver.
    """
    group_fields, kinds = key_fields(cells, keys), state.schema
    narrow = cells.select(*keys, "x", "runs", "hits")

    def work(pairs: Pairs) -> Iterator[pa.RecordBatch]:
        held = Partials(group_fields)
        for key, (fact,), batch in pairs:
            x, runs, hits = (batch.column(batch.schema.get_field_index(c)) for c in ("x", "runs", "hits"))
            runs, hits = (w.flatten().to_numpy().reshape(-1, size).astype(float) for w in (runs, hits))
            on = fact["open"]
            made = np.zeros((size, 5))
            made[on] = step_sums(x.to_numpy(), runs[:, on], hits[:, on], fact["beta"].reshape(size, 2)[on])
            held.add(key, made.ravel())
            if held.full():
                yield from held.batches()
        yield from held.batches()

    def step(row: dict) -> dict:
        beta = np.array(row["beta"], dtype=float).reshape(size, 2)
        on, ok = np.array(row["open"], dtype=bool), np.array(row["ok"], dtype=bool)
        if row["acc"] is not None:
            advance(beta, solve_step(np.array(row["acc"]).reshape(size, 5)[on]), on, ok)
        return {**{k: row[k] for k in keys}, "beta": beta.ravel().tolist(), "open": on.tolist(), "ok": ok.tolist()}

    moving = F.exists("open", lambda v: v)
    for _ in range(MAX_ITER):
        left = state.where(moving)
        count = left.count()
        if not count:
            break
        sums = summed(meet(narrow, left.select(*keys, "beta", "open"), keys, work,
                           vector_schema(cells, keys), 24 * size + 64, count), keys)
        state = materialise(per_row(state.join(sums, keys, "left"), step, kinds))
    return state
