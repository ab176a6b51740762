"""Per-room Python over a DataFrame: one shuffle by room, rooms streamed one after the other through each task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructType, _parse_datatype_string

_KINDS = {LongType: pa.int64(), IntegerType: pa.int32(), StringType: pa.string(), BooleanType: pa.bool_()}


def _kind(t: DataType) -> pa.DataType:
    return pa.list_(_kind(t.elementType)) if isinstance(t, ArrayType) else _KINDS[type(t)]


def _batch(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema.fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _kind(f.dataType)) for f, c in zip(schema.fields, columns, strict=True)], schema.names)


def _values(c: pa.Array) -> list:
    """Python values of a column, many at once; nulls are None."""
    if pa.types.is_list(c.type):
        flat, ends = _values(c.flatten()), c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum().tolist()
        out = [flat[s:e] for s, e in zip([0, *ends], ends, strict=False)]
    elif pa.types.is_integer(c.type) or pa.types.is_boolean(c.type):
        out = c.fill_null(False if pa.types.is_boolean(c.type) else 0).to_numpy(zero_copy_only=False).tolist()
    elif pa.types.is_string(c.type):
        return c.to_numpy(zero_copy_only=False).tolist()
    else:
        return c.to_pylist()
    if c.null_count:
        for i in c.is_null().to_numpy(zero_copy_only=False).nonzero()[0].tolist():
            out[i] = None
    return out


def by_room(df: DataFrame, run: Callable[[object, list], Iterable[tuple]], schema: str, keys: tuple[str, ...] = ("room_id",), order: tuple[str, ...] = ()) -> DataFrame:
    """The rows that run(key, rows) makes for each room; a task holds one room's rows at a time.

    Rows travel as Arrow, not pandas: a null beside them leaves ids beyond 2^53 as they are. They are dealt by a hash of
    the keys, not by the keys: rows that lie by the keys already would get no shuffle of their own, and nothing then keeps
    a room together, for Spark merges, splits and reads partitions at will where no operator above asks for an order of them.
    """
    out = _parse_datatype_string(schema)
    names = list(df.columns)
    at = [names.index(k) for k in keys]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Each key with its rows, which may lie in several batches."""
        held_key, held = None, []
        for b in batches:
            columns = [_values(c) for c in b.columns]
            rows = list(zip(*columns, strict=True))
            found = columns[at[0]] if len(at) == 1 else list(zip(*(columns[k] for k in at), strict=True))
            start = 0
            for end in [*(i for i, (x, y) in enumerate(pairwise(found), 1) if x != y), *([len(rows)] if rows else [])]:
                if held and found[start] == held_key:
                    held += rows[start:end]
                else:
                    if held:
                        yield held_key, held
                    held_key, held = found[start], rows[start:end]
                start = end
        if held:
            yield held_key, held

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for key, group in groups(batches):
            for row in run(key, group):
                held.append(row)
                if len(held) >= 10_000:
                    yield _batch(held, out)
                    held = []
        if held:
            yield _batch(held, out)

    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(task, out)
