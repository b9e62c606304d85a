"""Best-fit packing of token sequences with large-item matching.

Lengths are whole numbers up to the capacity, so the corpus enters the plan only as a histogram
of at most ``capacity`` counts, whatever its size.  The plan works on counts: items above a
third of the capacity fit at most twice into a bin and are matched greedily, largest with the
largest that still fits; smaller ones then go, longest first, to the smallest gap that holds
them.  A plan row says which ranks of a length go to which run of equal bins.  The rows take
their rank within their length from ordered slices, so no length is gathered in one task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwatch import runtime

from . import shared, tokens

CAPACITY = 2048
END_ID = 0


def encode_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids``: token ids (little-endian uint32) of every document.

    A document is its ids and ``end_id``.  Only one longer than ``capacity`` is cut; its first
    piece takes the remainder, all others are full.  A NULL or empty text is the end id alone.
    """
    schema = "doc_id long, piece int, start long, length long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for lo, texts in tokens.encoded(batch.column("text")):
                row, piece, start, length, ids = [], [], [], [], []
                for k, one in enumerate(texts):
                    whole = np.concatenate([one, end])
                    first = len(whole) % capacity or capacity
                    cuts = [0, *range(first, len(whole) + 1, capacity)]
                    for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        row.append(lo + k)
                        piece.append(j)
                        start.append(a)
                        length.append(b - a)
                        ids.append(whole[a:b].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"])

    return shared.bounded(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, schema)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first bin, items per bin, offset) for a histogram.

    The number of rows depends on the number of distinct lengths, not on the counts.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("a length must lie between 1 and the capacity")
    runs: list[tuple[int, tuple[tuple[int, int], ...]]] = []  # (bins, ((length, items), ...))
    gaps: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}

    def put(bins, content, gap):
        if bins:
            gaps.setdefault(gap, []).append((bins, content))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        top = large[-1]
        at = bisect.bisect_right(large, capacity - top) - 1
        mate = large[at] if at >= 0 else None
        if mate is None:
            put(left[top], ((top, 1),), capacity - top)
            large.pop()
        elif mate == top:
            put(left[top] // 2, ((top, 2),), capacity - 2 * top)
            put(left[top] % 2, ((top, 1),), capacity - top)
            large.pop()
        else:
            pairs = min(left[top], left[mate])
            put(pairs, ((top, 1), (mate, 1)), capacity - top - mate)
            for n in (top, mate):
                left[n] -= pairs
                if not left[n]:
                    large.remove(n)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        wanted = left[n]
        while wanted:
            fitting = [g for g in gaps if g >= n]
            if not fitting:
                each = capacity // n
                put(wanted // each, ((n, each),), capacity - each * n)
                rest = wanted % each
                put(int(rest > 0), ((n, rest),), capacity - rest * n)
                break
            gap = min(fitting)
            bins, content = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            each = gap // n
            full = min(bins, wanted // each)
            rest = 0 if full == bins else wanted - full * each
            put(full, (*content, (n, each)), gap - each * n)
            put(int(rest > 0), (*content, (n, rest)), gap - rest * n)
            put(bins - full - (rest > 0), content, gap)
            wanted -= full * each + rest
    for same in gaps.values():
        runs += same
    rows, used, base = [], {}, 0
    for bins, content in runs:
        offset = 0
        for n, each in content:
            first = used.get(n, 0)
            used[n] = first + bins * each
            rows.append((n, first, used[n], base, each, offset))
            offset += n * each
        base += bins
    return rows


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Append ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, length``.

    Equal rows are interchangeable.  An empty table stays empty.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    # equal lengths lie side by side in ordered slices; the row number inside a slice is local
    parts = shared.shuffle_width(spark)
    ranged = pieces.repartitionByRange(parts, "length", "doc_id", "piece").sortWithinPartitions(
        "length", "doc_id", "piece").withColumn("_at", F.monotonically_increasing_id())
    ranged = shared.stored(ranged.withColumn("_slice", F.shiftright("_at", 33)))
    counts = ranged.groupBy("length", "_slice").agg(F.count("*").alias("n"), F.min("_at").alias("_from"))
    counts = runtime.materialise(counts)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan_bins(histogram, capacity)
    plan = spark.createDataFrame(
        rows, "length long, _first long, _end long, _bin long, _each long, _offset long")
    line = F.sum("n").over(shared.Window.partitionBy("length").orderBy("_slice").rowsBetween(
        shared.Window.unboundedPreceding, -1))
    ranks = counts.select("length", "_slice", (F.coalesce(line, F.lit(0)) - F.col("_from")).alias("_shift"))
    ranked = runtime.attach(ranged, ranks, ["length", "_slice"], row_bytes=64)
    ranked = ranked.withColumn("_rank", F.col("_at") + F.col("_shift"))
    # at most a few runs of bins for each of the at most `capacity` lengths
    place = (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("_first")) & (
        F.col("_rank") < F.col("_end"))
    put = ranked.join(F.broadcast(plan), place).drop(plan["length"])
    step = F.col("_rank") - F.col("_first")
    return put.select(
        *names, (F.col("_bin") + F.floor(step / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(step, F.col("_each")) * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece.

    ``encode_pieces`` gives the ids themselves under the same (doc_id, piece).  NULL texts pack
    as empty ones, a NULL id stays NULL, repeated rows are packed each for itself, other columns
    of ``docs`` are not read.
    """
    # stored before the range partitioning, which reads its input twice
    pieces = shared.stored(
        encode_pieces(docs, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return assign(pieces, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
