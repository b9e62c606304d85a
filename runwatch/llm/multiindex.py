"""Near-duplicate vectors through an inverted multi-index.

A vector is scaled to length one and cut into two halves, each with a codebook of its own; the
pairs of codewords form a grid of cells, and every vector lies in the cell of its nearest pair.
A probe walks the cells by the sum of its two distances and stops where that sum exceeds the
nearest one by ``reach``.  ``reach`` is set on samples so that neighbours exactly at the threshold -
the hardest ones - are met from one side or the other at the target recall: neighbours by noise in
all directions, real pairs of a sample, and steps along the directions in which the data vary.
Every pair that meets is verified in double precision.

Cells are compared in blocks of bounded size.  A block returns counts and one edge per linked
vector, never its pairs, so a group of thousands of copies stays small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwatch import runtime

from . import shared
from .minhash import forest

THRESHOLD = 0.93
#: rows the codebooks and the reach are fitted on, at most about so many
SAMPLE = 20_000
#: vectors per cell the codebook size aims at
PER_CELL = 256
MAX_CODEWORDS = 2048
RECALL = 0.999
#: vectors the reach is measured from, partners of one vector, and the cosines counted as near the threshold
PROBES = 4000
PARTNERS = 8
NEAR = 0.01
#: vectors of one side of a block
BLOCK = 256


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1)[None, :]


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    book = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = _distances(x, book).argmin(1)
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(book))
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
    return book


def _picked(able: np.ndarray, most: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of at most ``most`` random true cells of each row."""
    draw = np.where(able, rng.random(able.shape, np.float32), np.float32(2))
    most = min(most, able.shape[1])
    at = np.argpartition(draw, most - 1, axis=1)[:, :most]
    row, k = np.nonzero(np.take_along_axis(able, at, 1))
    return row, at[row, k]


def _neighbours(x: np.ndarray, own: np.ndarray, held: np.ndarray, labels: np.ndarray, threshold: float,
                rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Three kinds of pairs of ``x`` (labels ``own``) with what ``held`` (``labels``) shows of its neighbours.

    Real pairs of one label just above the threshold; all real pairs above it; and where the
    sample is too thin to hold pairs, steps from a vector towards its nearest others below the
    threshold, as long as the threshold allows.  No row gives more than a few pairs of a kind,
    so that a hot group does not hide the others.
    """
    kinds = [[], [], []]
    for lo in range(0, len(x), 256):
        part = x[lo:lo + 256]
        cosine = part @ held.T
        alike = own[lo:lo + 256, None] == labels[None, :]
        linked = alike & (cosine >= threshold) & (cosine < 1 - 1e-9)
        for kind, able in ((kinds[0], linked & (cosine < threshold + NEAR)), (kinds[1], linked)):
            if able.any():
                row, at = _picked(able, PARTNERS, rng)
                kind.append((part[row], held[at]))
        # others of the same label come first, those of any label only where it has none
        rank = np.where(cosine < threshold, cosine - 4 * ~alike, -9.0)
        most = min(PARTNERS, len(held))
        at = np.argpartition(-rank, most - 1, axis=1)[:, :most]
        best = np.take_along_axis(rank, at, 1)
        row, k = np.nonzero((best > -9) & (best >= best.max(1)[:, None] - 2))
        kinds[2].append((part[row], _at_threshold(part[row], held[at[row, k]], threshold)))
    return [tuple(np.concatenate(side) for side in zip(*kind)) for kind in kinds if kind]


def _at_threshold(x: np.ndarray, way: np.ndarray, threshold: float) -> np.ndarray:
    """Unit vectors with cosine ``threshold`` to ``x`` in the direction of ``way``."""
    away = way - (way * x).sum(1)[:, None] * x
    away /= np.maximum(np.linalg.norm(away, axis=1), 1e-300)[:, None]
    return threshold * x + np.sqrt(1 - threshold * threshold) * away


def fit(sample: np.ndarray, codewords: int, threshold: float, recall: float, seed: int = 7,
        held: np.ndarray | None = None, labels: np.ndarray | None = None):
    """(codebook of the first half, of the second half, reach) from unit vectors.

    ``reach`` is the largest that noise in all directions or any kind of ``_neighbours`` asks
    for.  The latter come from ``held`` with its ``labels``: vectors the codebooks have not
    seen, or the sample where that is all there is.
    """
    rng = np.random.default_rng(seed)
    half = sample.shape[1] // 2
    books = [_codebook(sample[:, :half], codewords, rng), _codebook(sample[:, half:], codewords, rng)]
    held = sample if held is None or not len(held) else held
    labels = np.zeros(len(held)) if labels is None or len(labels) != len(held) else labels
    x = sample[rng.choice(len(sample), PROBES)]
    kinds = [(x, _at_threshold(x, rng.normal(size=x.shape), threshold))]
    at = rng.choice(len(held), min(PROBES, len(held)), replace=False)
    kinds += _neighbours(held[at], labels[at], held, labels, threshold, rng)

    def excess(a, b):
        """How much farther b's cell is from a than a's own cell."""
        out = 0.0
        for part, book in ((slice(None, half), books[0]), (slice(half, None), books[1])):
            da = _distances(a[:, part], book)
            out = out + da[np.arange(len(a)), _distances(b[:, part], book).argmin(1)] - da.min(1)
        return out

    def asked(a, b):
        lowest = [np.minimum(excess(a[k:k + PROBES], b[k:k + PROBES]), excess(b[k:k + PROBES], a[k:k + PROBES]))
                  for k in range(0, len(a), PROBES)]
        return np.quantile(np.concatenate(lowest), recall)

    reach = max(asked(a, b) for a, b in kinds if len(a))
    return books[0], books[1], float(reach) * 1.05 + 1e-9


def cells(x: np.ndarray, first: np.ndarray, second: np.ndarray, reach: float):
    """Own cell of each unit vector, and (row, cell) of every cell its traversal visits."""
    half = x.shape[1] // 2
    own, rows, found = [], [], []
    for lo in range(0, len(x), 512):
        part = x[lo:lo + 512]
        d1, d2 = _distances(part[:, :half], first), _distances(part[:, half:], second)
        own.append(d1.argmin(1) * len(second) + d2.argmin(1))
        e1, e2 = d1 - d1.min(1)[:, None], d2 - d2.min(1)[:, None]
        row, c1 = np.nonzero(e1 <= reach)
        at, c2 = np.nonzero(e1[row, c1][:, None] + e2[row] <= reach)
        rows.append(row[at] + lo)
        found.append(c1[at] * len(second) + c2)
    return np.concatenate(own), np.concatenate(rows), np.concatenate(found)


def _units(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column whose rows all have the same length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = values.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def compare_block(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Count links of probes and members of one block; roots of its local components.

    A member counts a probe only if its own traversal does not visit the probe's cell, else it
    meets that vector as a probe itself.
    """
    empty = pd.DataFrame({"vec_id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64),
                          "root": np.zeros(0, np.int64)})
    sides = [pdf[pdf["side"] == s].sort_values("vec_id") for s in (0, 1)]
    if not (len(sides[0]) and len(sides[1])):
        return empty
    x = [np.frombuffer(b"".join(s["vector"]), np.float64).reshape(len(s), -1) for s in sides]
    ids = [s["vec_id"].to_numpy() for s in sides]
    links = (x[0] @ x[1].T >= threshold) & (ids[0][:, None] != ids[1][None, :])
    if not links.any():
        return empty
    own, visits = sides[0]["own"].to_numpy(), sides[1]["visits"].tolist()
    home = np.unique(own)
    mutual = np.array([np.isin(home, v) for v in visits])[:, np.searchsorted(home, own)].T
    counts = (links.sum(1), (links & ~mutual).sum(0))
    roots = dict(forest(links, ids[0], ids[1]))
    out = pd.DataFrame({"vec_id": np.concatenate(ids), "n": np.concatenate(counts)})
    out["root"] = [roots.get(v, v) for v in out["vec_id"].tolist()]
    return out[(out["n"] > 0) | (out["root"] != out["vec_id"])].astype("int64")


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE,
                 per_cell: int = PER_CELL, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``(vec_id, embedding, label)``.

    Only vectors of equal, known label and equal dimension are compared.  A vector that is NULL,
    zero, or holds NULL or non-finite components, and a row with a NULL id or label, links with
    nothing; a NULL id has a NULL component and is kept.  Repeated rows are one vector and get
    the same result each; an id with several vectors has the links of all of them.  An empty
    table gives an empty result; further columns are not read.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("string"),
                             F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
    good = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    good = good.where(finite).where((norm > 0) & (norm < float("inf"))).distinct()
    good = shared.stored(good.withColumn("dim", F.size("embedding")))
    dims = {r["dim"]: r["count"] for r in good.groupBy("dim").count().collect()}
    books = {}
    for dim, n in dims.items():
        if dim < 2:
            continue
        share = int(np.ceil(1e6 * min(1.0, sample / n)))
        draw = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000))
        picked = good.where(F.col("dim") == dim).where(draw < F.lit(min(2 * share, 1_000_000)))
        picked = picked.select("embedding", "label", (draw < F.lit(share)).alias("fits")).toPandas()
        words = int(min(MAX_CODEWORDS, max(1, np.sqrt(n / per_cell))))
        fits = picked["fits"].to_numpy(bool)
        if fits.any():
            x = np.array(picked["embedding"].tolist(), np.float64)
            x /= np.linalg.norm(x, axis=1)[:, None]
            # rows left for the reach may be few where the sample is most of the table; then it sees all
            unseen = ~fits if 2 * share <= 1_000_000 else np.ones(len(x), bool)
            books[dim] = fit(x[fits], words, threshold, recall, held=x[unseen],
                             labels=np.unique(picked["label"], return_inverse=True)[1][unseen])
    shipped = spark.sparkContext.broadcast(books)  # two books of at most MAX_CODEWORDS halves a dimension

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_dims = batch.column("dim").to_numpy()
            for dim in np.unique(all_dims):
                part = batch.filter(pa.array(all_dims == dim))
                x = _units(part.column("embedding"))
                n = len(x)
                if dim in shipped.value:
                    own, row, found = cells(x, *shipped.value[dim])
                else:
                    own, row, found = np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64)
                cut = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                raw = [v.tobytes() for v in x]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), part.column("dim"),
                     pa.array(own.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(cut), pa.array(found.astype(np.int32))),
                     pa.array(raw, pa.binary())],
                    ["vec_id", "label", "dim", "own", "visits", "vector"])

    placed = shared.stored(good.select("vec_id", "label", "dim", "embedding").mapInArrow(
        place, "vec_id long, label string, dim int, own int, visits array<int>, vector binary"))
    key = ["label", "dim", "cell"]
    members = placed.withColumn("cell", F.col("own"))
    probes = placed.withColumn("cell", F.explode("visits"))
    size = members.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m")).join(
        probes.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("p")), key)
    size = runtime.materialise(size)
    count = size.count()
    mine = F.xxhash64("vec_id")

    def side(frame: DataFrame, number: int, own: str, other: str) -> DataFrame:
        whole = runtime.attach(frame, size, key, row_bytes=64, rows=count)
        whole = whole.withColumn("_a", F.pmod(mine, F.col(own)).cast("int")).withColumn(
            "_b", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        i, j = ("_a", "_b") if number == 0 else ("_b", "_a")
        return whole.select(*key, F.col(i).alias("i"), F.col(j).alias("j"), F.lit(number).alias("side"),
                            "vec_id", "own", "visits", "vector")

    blocks = side(probes, 0, "p", "m").union(side(members, 1, "m", "p"))
    counted = shared.stored(blocks.groupBy(*key, "i", "j").applyInPandas(
        lambda pdf: compare_block(pdf, threshold), "vec_id long, n long, root long"))
    found = shared.components(counted.where("vec_id != root"), "vec_id", "root")
    links = counted.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    out = embeddings.select(F.col("vec_id").cast("long")).join(links, "vec_id", "left").join(
        found.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
