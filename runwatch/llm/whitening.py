"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

The centred scatter of the vectors is summed in Arrow functions, a triangle a task, and added
in a tree.  One task factors it: Cholesky with diagonal pivoting gives a triangular factor L
with P'SP = LL', and one-sided Jacobi rotates the columns of L until they are orthogonal.
Squared column norms are then the eigenvalues of the scatter and the normalised columns its
eigenvectors; the product LL' is never formed again, so small eigenvalues keep their digits.

Entries are integers, ``x = floor(1024 c) + 100000``: counts and sums are exact whatever the
partitioning, and ``n x - sum`` is an exact integer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwatch.operators.sums import partial_vectors, summed

from . import shared

SCALE, SHIFT = 1024, 100_000
#: entries beyond this many units count as this many, so that they stay integers
_LARGEST = 1 << 61
#: sums are kept as four parts of 16 bits: exact in doubles up to 2^37 vectors
_LIMBS, _LIMB_BITS = 4, 16
_SWEEPS = 80


@dataclass(frozen=True)
class Whitening:
    """What the vectors of one length are whitened with.

    ``sums`` are exact; ``values`` are the leading eigenvalues of the covariance (0 where the
    scatter has no further rank) and ``vectors`` their unit eigenvectors, a row each.
    """

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n in double precision, from exact whole parts."""
        whole, rest = self._centre()
        return (x - whole).astype(float) - rest / self.n

    def _centre(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [divmod(s, self.n) for s in self.sums]
        return np.array([q for q, _ in parts], np.int64), np.array([r for _, r in parts], float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of variance 1; NaN for a component of eigenvalue 0."""
        root = np.sqrt(np.where(self.values > 0, self.values, np.nan))
        return self.centred(x) @ (self.vectors.T / root)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """sum (n x - S)^2 as exact decimals of 38 digits, NULL beyond them."""
        parts = [divmod(s, self.n) for s in self.sums]
        away = x - np.array([q for q, _ in parts], np.int64)
        far = int(np.abs(away).max(initial=0)) + 1
        if (far * self.n) ** 2 * x.shape[1] < 1 << 62:
            d = away * self.n - np.array([r for _, r in parts], np.int64)
            return pa.array((d * d).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
        d = away.astype(object) * self.n - np.array([r for _, r in parts], object)
        total = [int(v) for v in (d * d).sum(axis=1)]
        return pa.array([Decimal(v) if v < 10**38 else None for v in total], pa.decimal128(38, 0))

    def explained(self) -> list[float | None]:
        return [float(v) / self.trace if self.trace > 0 else None for v in self.values]


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, x) for each vector length of a batch, as integers of 1/1024.

    Vectors that are NULL, empty, or hold a NULL or non-finite entry are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for p in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == p)
        c = flat[starts[rows][:, None] + np.arange(p)]
        whole = np.isfinite(c).all(axis=1)
        with np.errstate(over="ignore"):
            units = np.clip(np.floor(c[whole] * SCALE), -_LARGEST, _LARGEST)
        yield int(p), rows[whole], units.astype(np.int64) + SHIFT


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(L, order)`` with ``a[order][:, order] = L L'``; L has as many columns as a has rank.

    The pivot is the largest diagonal entry left; what is below p * eps of the first one is 0.
    """
    p = len(a)
    a, order = np.array(a, float), np.arange(p)
    low, left = np.zeros((p, p)), np.diag(a).copy()
    floor = p * np.finfo(float).eps * left.max(initial=0.0)
    for j in range(p):
        k = j + int(np.argmax(left[j:]))
        if not left[k] > floor:
            return low[:, :j], order
        for both in (order, left, low, a):
            both[[j, k]] = both[[k, j]]
        a[:, [j, k]] = a[:, [k, j]]
        low[j, j] = np.sqrt(left[j])
        below = slice(j + 1, p)
        low[below, j] = (a[below, j] - low[below, :j] @ low[j, :j]) / low[j, j]
        left[below] -= low[below, j] ** 2
    return low, order


def _rounds(r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of 0..r-1 (r even) once, in r - 1 rounds of disjoint pairs."""
    ring = np.arange(r)
    for _ in range(r - 1):
        yield ring[: r // 2], ring[: r // 2 - 1: -1]
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])


def one_sided_jacobi(low: np.ndarray) -> np.ndarray:
    """``low`` times a product of rotations, with orthogonal columns (to working precision)."""
    p, r = low.shape
    u = np.zeros((r + r % 2, p))
    u[:r] = low.T
    small = np.finfo(float).eps * max(p, 1)
    for _ in range(_SWEEPS):
        turned = False
        for i, j in _rounds(len(u)):
            a, b = u[i], u[j]
            aa, bb, ab = (a * a).sum(axis=1), (b * b).sum(axis=1), (a * b).sum(axis=1)
            slanted = np.abs(ab) > small * np.sqrt(aa * bb)
            if not slanted.any():
                continue
            turned = True
            z = np.where(slanted, (bb - aa) / np.where(slanted, 2 * ab, 1.0), 0.0)
            t = np.where(slanted, np.copysign(1.0, z) / (np.abs(z) + np.hypot(1.0, z)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            s = (c * t)[:, None]
            c = c[:, None]
            u[i], u[j] = c * a - s * b, s * a + c * b
        if not turned:
            return u[:r].T
    raise ArithmeticError(f"Jacobi rotations did not settle in {_SWEEPS} sweeps")


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a scatter matrix, falling, and its unit eigenvectors as rows, up to its rank.

    The entry of largest magnitude of each vector is positive.
    """
    low, order = pivoted_cholesky(scatter)
    turned = one_sided_jacobi(low)
    norms = np.sqrt((turned * turned).sum(axis=0))
    rank = np.argsort(-norms, kind="stable")
    vectors = np.empty((len(rank), len(scatter)))
    vectors[:, order] = (turned[:, rank] / norms[rank]).T
    top = np.abs(vectors).argmax(axis=1)
    vectors *= np.copysign(1.0, vectors[np.arange(len(rank)), top])[:, None]
    return norms[rank] ** 2, vectors


def _sums(narrow: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Vector length -> (n, exact sums)."""
    def vectors(batch: pa.RecordBatch):
        for p, rows, x in matrices(batch.column("v")):
            parts = [x & 0xFFFF, (x >> 16) & 0xFFFF, (x >> 32) & 0xFFFF, x >> 48]
            yield (p,), np.concatenate([[len(rows)], *[q.sum(axis=0) for q in parts]]).astype(float)

    found = {}
    for row in summed(partial_vectors(narrow, ["p"], vectors), ["p"]).collect():
        parts = np.array(row["acc"][1:]).reshape(_LIMBS, row["p"])
        if row["acc"][0] > 0:
            found[row["p"]] = (int(row["acc"][0]), tuple(
                sum(int(parts[k, j]) << (_LIMB_BITS * k) for k in range(_LIMBS)) for j in range(row["p"])))
    return found


def fit(vectors: DataFrame, components: int = 8, column: str = "embedding") -> dict[int, Whitening]:
    """Vector length -> its whitening, over all usable vectors of ``column``.

    Vectors of different lengths cannot share a covariance: each length is a fit list of its
    own.  No usable vector gives an empty dict.  Three scans: exact sums, the centred scatter,
    and the covariance of the whitened vectors themselves, for ``identity_error``.  The driver
    receives the sums and ``components`` vectors for each length, never a scatter matrix.
    """
    narrow = shared.bounded(vectors.select(F.col(column).alias("v"), F.lit(0).alias("p")))
    none = np.zeros(0)
    plain = {p: Whitening(n, s, none, np.zeros((0, p)), 0.0) for p, (n, s) in _sums(narrow).items()}

    def scatter(batch: pa.RecordBatch):
        for p, _, x in matrices(batch.column("v")):
            if p in plain:
                d = plain[p].centred(x)
                yield (p,), (d.T @ d)[np.triu_indices(p)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                p = batch.column("p")[row].as_py()
                upper = batch.column("acc")[row].values.to_numpy(zero_copy_only=False)
                full = np.zeros((p, p))
                full[np.triu_indices(p)] = upper
                values, basis = eigen(full + np.triu(full, 1).T)
                n = plain[p].n
                yield pa.RecordBatch.from_pydict({
                    "p": pa.array([p], pa.int32()), "trace": [float(np.trace(full)) / n],
                    "values": [values[:components] / n], "basis": [basis[:components].ravel()]})

    sums = summed(partial_vectors(narrow, ["p"], scatter), ["p"])
    fitted = {}
    for r in sums.mapInArrow(solve, "p int, trace double, values array<double>, basis array<double>").collect():
        p, rank = r["p"], len(r["values"])
        k = min(components, p)
        values, basis = np.zeros(k), np.zeros((k, p))
        values[:rank], basis[:rank] = r["values"], np.array(r["basis"]).reshape(rank, p)
        fitted[p] = Whitening(plain[p].n, plain[p].sums, values, basis, r["trace"])

    def covariance(batch: pa.RecordBatch):
        for p, _, x in matrices(batch.column("v")):
            if p in fitted:
                w = np.nan_to_num(fitted[p].whitened(x))
                yield (p,), np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    for r in summed(partial_vectors(narrow, ["p"], covariance), ["p"]).collect():
        f = fitted[r["p"]]
        k = len(f.values)
        acc = np.array(r["acc"]) / f.n
        rank = int((f.values > 0).sum())
        off = acc[k:].reshape(k, k) - np.outer(acc[:k], acc[:k]) - np.eye(k)
        error = float(np.abs(off[:rank, :rank]).max()) if rank else None
        fitted[r["p"]] = Whitening(f.n, f.sums, f.values, f.vectors, f.trace, error)
    return fitted


def whiten(vectors: DataFrame, components: int = 8, id_column: str = "vec_id",
           column: str = "embedding") -> DataFrame:
    """One row per usable vector and component, numbered from 1 by falling eigenvalue.

    ``<id>, component, n, deviation, whitened, explained, identity_error``: n is the number of
    fitted vectors, ``deviation`` (decimal) the exact sum over the entries of (n x - S)^2, NULL
    beyond 38 digits.  A vector that is NULL, empty, or holds a NULL or non-finite entry has no
    row; vectors of other lengths are whitened among themselves; repeated rows count and return
    as often as they occur; ids may be NULL or repeated; other columns are not read.  A vector of
    p entries has min(``components``, p) rows.  A component beyond the rank (all vectors equal,
    a single vector) has ``whitened`` NULL and ``explained`` 0, which is NULL too where all
    variances are 0; ``identity_error`` covers the other components and is NULL without any.
    Entries beyond 2^61 / 1024 count as that.
    """
    fitted = fit(vectors, components, column)
    narrow = shared.bounded(vectors.select(id_column, F.col(column).alias("v")))
    name = vectors.schema[id_column]
    kind = name.dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, rows, x in matrices(batch.column("v")):
                f = fitted.get(p)
                if f is None or not len(rows):
                    continue
                m, k = len(rows), len(f.values)
                each = np.repeat(np.arange(m), k)
                w = f.whitened(x).ravel()
                error = [f.identity_error] * (m * k)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, f.n)), f.deviations(x).take(pa.array(each)),
                    pa.array(w, mask=np.isnan(w)), pa.array(f.explained() * m, pa.float64()),
                    pa.array(error, pa.float64())],
                    [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return narrow.mapInArrow(run, f"`{id_column}` {kind}, component int, n long, deviation decimal(38,0), "
                             "whitened double, explained double, identity_error double")
