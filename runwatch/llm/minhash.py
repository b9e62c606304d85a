"""Near-duplicate texts: circulant MinHash, banding, exact Jaccard on whole shingle sets.

All coordinates of a signature come from two permutations of the 32-bit numbers: the first
spreads the shingle hashes, the second is applied after a circular shift by the number of the
coordinate.  Documents with equal shingle sets are one representative from the start.  The
representatives that share a band are compared in blocks of bounded size; a block returns one
edge per linked document, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwatch import runtime

from . import shared, words

SHINGLE = 5
#: link documents with 100 * intersection >= PERCENT * union
PERCENT = 85
BANDS = 24
ROWS = 8
#: documents of one side of a block
BLOCK = 128
#: shingles whose hashes are worked on at a time
_CELLS = 1 << 15


def _permute(x: np.ndarray) -> np.ndarray:
    """The second permutation, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row per set of 64-bit shingle hashes; no set may be empty."""
    out = np.empty((len(sets), coordinates), np.uint32)
    lo = 0
    while lo < len(sets):
        hi, n = lo, 0
        while hi < len(sets) and (hi == lo or n + len(sets[hi]) <= _CELLS):
            n += len(sets[hi])
            hi += 1
        first = (np.concatenate(sets[lo:hi]) >> np.uint64(32)).astype(np.uint32)
        first = first * np.uint32(0x9E3779B1) ^ np.uint32(0x5BD1E995)
        borders = np.cumsum([0] + [len(s) for s in sets[lo:hi - 1]])
        for k in range(coordinates):
            out[lo:hi, k] = np.minimum.reduceat(_permute(first - np.uint32(k)), borders)
        lo = hi
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; keys of different bands never meet on purpose."""
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64)
        for k in range(rows):
            h = words.mix((h * np.uint64(0x9FB21C651E98DF25)) ^ signature[:, b * rows + k])
        out[:, b] = h
    return out.view(np.int64)


def shingle_table(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, s1, s2, bands``: size, 128-bit hash and band keys of each shingle set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = words.texts_of(batch.column("text"))
            for lo, hi in words.groups_of_bytes(at, words.BLOCK):
                h, pos = words.all_words(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                sets = [words.shingles(h[pos[i]:pos[i + 1]], width) for i in range(hi - lo)]
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                keys = np.zeros((hi - lo, bands), np.int64)
                some = [sets[i] for i in full]
                if some:
                    keys[full] = band_keys(signatures(some, bands * rows), bands, rows)
                with np.errstate(over="ignore"):
                    s1 = np.array([words.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                    s2 = np.array([words.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                                   for s in sets], np.uint64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (hi - lo) * bands + 1, bands, dtype=np.int32)),
                    pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(s1.view(np.int64)),
                     pa.array(s2.view(np.int64)), lists],
                    ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return shared.bounded(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(
        run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def linked(sets: list[np.ndarray], left: int, same: bool, percent: int) -> np.ndarray:
    """Boolean matrix of links between the first ``left`` sets and the others (or among all)."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, ids, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared_ids = seen[ids] > 1
    rank = np.cumsum(seen > 1) - 1
    owner, ids = owner[shared_ids], rank[ids[shared_ids]]
    order = np.argsort(ids, kind="stable")
    owner, ids = owner[order], ids[order]
    a, b = (n, n) if same else (left, n - left)
    common = np.zeros((a, b))
    step = 1 << 14
    for lo in range(0, int(ids[-1]) + 1 if len(ids) else 0, step):
        s, e = np.searchsorted(ids, [lo, lo + step])
        cells = np.zeros((n, step), np.float32)
        cells[owner[s:e], ids[s:e] - lo] = 1
        common += cells @ cells.T if same else cells[:left] @ cells[left:].T
    size = np.array([len(s) for s in sets], float)
    total = (size[:, None] + size[None, :]) if same else (size[:left, None] + size[None, left:])
    return 100 * common >= percent * (total - common)


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges (id, smallest id of its local component) of the bipartite or square ``links``."""
    names = np.unique(np.concatenate([left, right]))
    i, j = np.nonzero(links)
    u, v = np.searchsorted(names, left[i]), np.searchsorted(names, right[j])
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(names)))
    return [(int(names[k]), int(names[root[k]])) for k in moved]


def compare_block(pdf: pd.DataFrame, width: int, percent: int) -> pd.DataFrame:
    """One block: side 0 against side 1, or side 0 with itself where there is no side 1."""
    pdf = pdf.sort_values(["side", "doc_id"])
    data, at = words.texts_of(pa.array(pdf["text"], pa.string()))
    h, pos = words.all_words(data, at)
    sets = [words.shingles(h[pos[i]:pos[i + 1]], width) for i in range(len(pdf))]
    ids, left = pdf["doc_id"].to_numpy(), int((pdf["side"] == 0).sum())
    same = bool(pdf["same"].iloc[0])
    if not same and left in (0, len(pdf)):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    links = linked(sets, left, same, percent)
    edges = forest(links, ids if same else ids[:left], ids if same else ids[left:])
    return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
                    width: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text)``.

    A NULL, empty or blank text has no shingles and is linked with nothing.  A row with a NULL
    id cannot be named by a link: it has a NULL component and is kept.  Rows that share an id
    are one document; links of any of its rows count for it.  Further columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    table = shared.stored(shingle_table(docs, bands, rows, width))
    able = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = able.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"))
    first = shared.stored(first)
    # a representative names its whole class of equal sets
    reps = able.join(first.withColumnRenamed("rep", "doc_id"), ["s1", "s2", "doc_id"]).select(
        "doc_id", F.explode("bands").alias("band"))
    member = shared.stored(reps.distinct())
    buckets = member.groupBy("band").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("who"))
    # bands that hold the same documents are one bucket
    buckets = buckets.where("n > 1").groupBy("n", "who").agg(F.min("band").alias("band"))
    buckets = buckets.withColumn("chunks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("who", "n")
    placed = runtime.materialise(member.join(buckets, "band").withColumn(
        "chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")))
    needed = runtime.materialise(placed.select("doc_id").distinct())
    texts = runtime.attach(docs, needed, ["doc_id"], row_bytes=32)
    chunk, chunks = F.col("chunk"), F.col("chunks")
    blocks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    blocks = blocks.select(
        "band", "doc_id", F.least(chunk, "other").alias("i"), F.greatest(chunk, "other").alias("j"),
        F.when(chunk <= F.col("other"), 0).otherwise(1).alias("side"), (chunk == F.col("other")).alias("same"))
    compared = blocks.join(texts, "doc_id").groupBy("band", "i", "j").applyInPandas(
        lambda pdf: compare_block(pdf, width, percent), "a long, b long")
    found = shared.components(shared.stored(compared))
    joined = table.join(first, ["s1", "s2"], "left").join(
        found.withColumnRenamed("id", "rep"), "rep", "left")
    able = F.col("n_shingles") > 0
    component = F.when(able, F.coalesce("component_id", "rep", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """The rows of ``docs``, all columns, without the other documents of each linked group.

    The document with the smallest id of a group stays; rows that share that id all stay.
    """
    found = near_duplicates(docs, percent, bands)
    gone = runtime.materialise(found.where("NOT kept").select("doc_id").distinct())
    return runtime.attach(docs, gone, ["doc_id"], row_bytes=32, how="left_anti").select(*docs.columns)
