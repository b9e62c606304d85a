"""Element-wise sums of long vectors: whole chunks of cells move, never a row per cell.

Every task that holds rows of a group makes one partial vector, cut into chunks of
``CHUNK`` cells.  The chunks are added in a tree of two levels: first those of the same
(group, chunk, branch), then those of the same (group, chunk).  A task adds sorted rows as
they stream by and holds one chunk, so neither the length of the vectors, nor the number of
groups, nor a hot group decides its memory.  What is shuffled is (partial vectors) x (bytes
of a vector), in rows of 32 KB, instead of a row per cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: cells of one chunk
CHUNK = 4096
#: branches of the tree: how many tasks share the partial vectors of a hot group
BRANCHES = 32
#: bytes of partial vectors a task holds before it hands them on
HELD_BYTES = 64 * 1024 * 1024

_CELLS = pa.list_(pa.float64())


class Partials:
    """The partial vectors of one task, by group; hands them on when they grow too large."""

    def __init__(self, fields: list[pa.Field]):
        self._fields = fields
        self._sums: dict[tuple, np.ndarray] = {}
        self._bytes = 0

    def add(self, key: tuple, vector: np.ndarray) -> None:
        if key in self._sums:
            self._sums[key] += vector
        else:
            self._sums[key] = np.array(vector, dtype=float)
            self._bytes += self._sums[key].nbytes

    def full(self) -> bool:
        return self._bytes > HELD_BYTES

    def batches(self) -> Iterator[pa.RecordBatch]:
        """``keys, _at, _cells`` for everything held, which is then forgotten."""
        sums, self._sums, self._bytes = self._sums, {}, 0
        for key, vector in sums.items():
            cuts = range(0, len(vector), CHUNK)
            rows = [vector[c:c + CHUNK] for c in cuts]
            yield _batch(self._fields, [key] * len(rows), list(range(len(rows))), rows)


def _batch(fields: list[pa.Field], keys: list[tuple], at: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    cells = pa.ListArray.from_arrays(ends, np.concatenate(rows) if rows else np.zeros(0))
    columns = [pa.array([k[i] for k in keys], f.type) for i, f in enumerate(fields)]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(at, pa.int32()), cells], [*[f.name for f in fields], "_at", "_cells"])


def partial_vectors(
    df: DataFrame, keys: list[str],
    vectors: Callable[[pa.RecordBatch], Iterator[tuple[tuple, np.ndarray]]],
) -> DataFrame:
    """``keys, _at, _cells``: the vectors a batch gives for each group, added within a task."""
    fields = key_fields(df, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Partials(fields)
        for batch in batches:
            for key, vector in vectors(batch):
                held.add(key, vector)
            if held.full():
                yield from held.batches()
        yield from held.batches()

    return df.mapInArrow(run, vector_schema(df, keys))


def summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, acc ARRAY<DOUBLE>``: the element-wise sums of the vectors of each group.

    The rows are added in the order of the partition they come from, so equal input in
    equal partitions gives equal bits.  A group without vectors has no row.
    """
    part = F.spark_partition_id()
    tagged = parts.withColumns({"_part": part, "_branch": F.pmod(part, F.lit(BRANCHES))})
    first = _added(tagged, keys, ["_branch"], ["_part"])
    whole = _added(first, keys, [], ["_branch"])
    chunk = F.struct("_at", "_cells")
    ordered = F.array_sort(F.collect_list(chunk))
    return whole.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda c: c["_cells"])).alias("acc"))


def _added(rows: DataFrame, keys: list[str], branch: list[str], order: list[str]) -> DataFrame:
    """One row per (keys, branch, chunk): a streaming sum over sorted rows."""
    group = [*keys, *branch, "_at"]
    fields = key_fields(rows, [*keys, *branch])
    width = len(fields)
    narrow = rows.select(*group, *order, "_cells").repartition(*group).sortWithinPartitions(*group, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            names = zip(*[batch.column(i).to_pylist() for i in range(width + 1)])
            cells = batch.column("_cells")
            ends = cells.offsets.to_numpy()
            flat = cells.values.to_numpy(zero_copy_only=False)
            for i, name in enumerate(names):
                row = flat[ends[i]:ends[i + 1]]
                if name == now:
                    total += row
                    continue
                if now is not None:
                    yield _batch(fields, [now[:-1]], [now[-1]], [total])
                now, total = name, np.array(row, dtype=float)
        if now is not None:
            yield _batch(fields, [now[:-1]], [now[-1]], [total])

    return narrow.mapInArrow(run, vector_schema(rows, [*keys, *branch]))


def key_fields(df: DataFrame, keys: list[str]) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(T.StructType([df.schema[k] for k in keys])))


def vector_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + [
        T.StructField("_at", T.IntegerType()), T.StructField("_cells", T.ArrayType(T.DoubleType()))])
