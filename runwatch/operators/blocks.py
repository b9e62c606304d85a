"""Rows meet the facts of their group (a model, a scaling) inside Arrow functions.

Facts of many sensors are large, so they must not be joined to every row.  A small table of
facts goes to every task as it is.  A larger one never passes through the driver: the rows of a
group are packed into blocks in the task that reads them, blocks and facts are joined on the
group as any two tables (broadcast while the facts are small enough, else a salted shuffle, so
that a hot group is spread out), and each joined block is unpacked next to its facts.  Rows are
read once either way, the facts travel once a block, and both ways work on streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import attach, bounded_batches

#: most bytes of facts that every task holds whole
LOCAL_BYTES = 16 * 1024 * 1024
#: bytes of a packed block, and of all blocks a task holds while it packs
BLOCK_BYTES = 1024 * 1024
HELD_BYTES = 64 * 1024 * 1024

Pairs = Iterator[tuple[tuple, list[dict], pa.RecordBatch]]


def meet(
    df: DataFrame, facts: DataFrame, keys: list[str], work: Callable[[Pairs], Iterator[pa.RecordBatch]],
    schema: T.StructType | str, row_bytes: int, rows: int | None = None, local: int | None = None,
) -> DataFrame:
    """``work`` over (key, facts of the group, rows of the group), batch by batch.

    ``facts`` has a row or a few per group; its arrays reach ``work`` as NumPy arrays, with NaN
    for NULL.  Rows of groups without facts are left out.  ``row_bytes`` is about the size of a
    row of ``facts``, ``rows`` their number where the caller knows it, ``local`` the bytes up to
    which every task gets them all.
    """
    rows = facts.count() if rows is None else rows
    if rows * row_bytes <= (LOCAL_BYTES if local is None else local):
        return _local(df, facts, keys, work, schema)
    return _packed(df, facts, keys, work, schema, row_bytes, rows)


def _local(df, facts, keys, work, schema) -> DataFrame:
    rest = [c for c in facts.columns if c not in keys]
    table: dict[tuple, list[dict]] = {}
    for row in facts.collect():
        fact = {c: _plain(row[c], facts.schema[c].dataType) for c in rest}
        table.setdefault(tuple(row[k] for k in keys), []).append(fact)
    sent = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        yield from work((key, known[key], part) for batch in batches
                        for key, part in by_group(batch, keys) if key in known)

    return df.mapInArrow(run, schema)


def _packed(df, facts, keys, work, schema, row_bytes, rows) -> DataFrame:
    key_fields = [df.schema[k] for k in keys]
    packed = df.mapInArrow(_packer(keys), T.StructType(
        [*key_fields, T.StructField("_block", T.BinaryType(), False)]))
    joined = bounded_batches(attach(packed, facts, keys, row_bytes=row_bytes, rows=rows))
    rest = [(c, facts.schema[c].dataType) for c in facts.columns if c not in keys]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Pairs:
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                key = tuple(at[k][i].as_py() for k in keys)
                fact = {c: _plain(_cell(at[c][i]), kind) for c, kind in rest}
                for part in pa.ipc.open_stream(at["_block"][i].as_buffer()):
                    yield key, [fact], part

    return joined.mapInArrow(lambda batches: work(pairs(batches)), schema)


def _packer(keys: list[str]):
    """Rows to ``keys, _block``: Arrow streams of about ``BLOCK_BYTES`` with rows of one group."""
    block_bytes, held_bytes = BLOCK_BYTES, HELD_BYTES

    def block(key: tuple, parts: list[pa.RecordBatch], fields: list[pa.Field]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        whole = pa.Table.from_batches(parts).combine_chunks()
        with pa.ipc.new_stream(sink, whole.schema) as out:
            out.write_table(whole)
        cells = [pa.array([k], f.type) for k, f in zip(key, fields)]
        return pa.RecordBatch.from_arrays(
            [*cells, pa.array([sink.getvalue().to_pybytes()], pa.binary())], [*keys, "_block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[pa.RecordBatch]] = {}
        size: dict[tuple, int] = {}
        total, fields = 0, []
        for batch in batches:
            fields = fields or [batch.schema.field(k) for k in keys]
            width = batch.nbytes / max(batch.num_rows, 1)
            for key, part in by_group(batch, keys):
                held.setdefault(key, []).append(part)
                grown = int(width * part.num_rows)
                size[key] = size.get(key, 0) + grown
                total += grown
                if size[key] >= block_bytes:
                    total -= size.pop(key)
                    yield block(key, held.pop(key), fields)
            if total >= held_bytes:
                for key in list(held):
                    yield block(key, held.pop(key), fields)
                size, total = {}, 0
        for key in list(held):
            yield block(key, held.pop(key), fields)

    return run


def by_group(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of each group of a batch."""
    if not batch.num_rows:
        return
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        column = batch.column(batch.schema.get_field_index(k)).dictionary_encode(null_encoding="encode")
        code = code * len(column.dictionary) + column.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1] if len(keys) > 1 else code
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[order])) + 1
    name = lambda i: tuple(batch.column(batch.schema.get_field_index(k))[i].as_py() for k in keys)
    if not len(cuts):
        yield name(0), batch
        return
    for part in np.split(order, cuts):
        yield name(int(part[0])), batch.take(pa.array(part))


def matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Numeric columns as doubles, a row each; NaN stands for NULL, NaN and infinities."""
    out = np.empty((batch.num_rows, len(columns)))
    for j, c in enumerate(columns):
        values = batch.column(batch.schema.get_field_index(c))
        if not pa.types.is_float64(values.type):
            values = values.cast(pa.float64())
        out[:, j] = values.to_numpy(zero_copy_only=False)
    out[~np.isfinite(out)] = np.nan
    return out


def repeated(value: object, kind: pa.DataType, times: int) -> pa.Array:
    """A column of one value."""
    if isinstance(value, np.ndarray):
        value = [None if v != v else v for v in value.tolist()]
    return pa.array([value], kind).take(pa.array(np.zeros(times, np.int64)))


def doubles(values: np.ndarray) -> pa.Array:
    """A column of doubles; NaN becomes NULL."""
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def _cell(scalar: pa.Scalar) -> object:
    if isinstance(scalar, pa.ListScalar) and scalar.is_valid and not pa.types.is_nested(scalar.values.type):
        return scalar.values.to_numpy(zero_copy_only=False)
    return scalar.as_py()


def _plain(value: object, kind: T.DataType) -> object:
    if value is None or not isinstance(kind, T.ArrayType):
        return value
    if isinstance(kind.elementType, (T.DoubleType, T.FloatType)):
        return np.asarray(value, dtype=float)
    if isinstance(kind.elementType, T.BooleanType):
        return np.asarray(value, dtype=bool)
    return value.tolist() if isinstance(value, np.ndarray) else value
