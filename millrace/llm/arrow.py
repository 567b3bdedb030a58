"""Arrow tables inside tasks, from plain column lists."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KINDS = {
    "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
    "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}


def fields_of(schema: str) -> pa.Schema:
    """The Arrow schema of a list of simple columns, written as Spark writes it."""
    return pa.schema([(name, KINDS[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])


def table_of(schema: str, columns: list) -> pa.Table:
    fields = fields_of(schema)
    made = [c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, fields)]
    return pa.table(made, schema=fields)


def text_slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``size`` bytes of a text column (a longer text is a slice)."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(int(np.searchsorted(ends, before + size, "right")), at + 1)
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Return freed memory to the system. Workers live on between tasks, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def lean(work: Callable) -> Callable:
    """A function for ``mapInArrow`` that keeps no freed memory when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


def lean_group(work: Callable) -> Callable:
    """The same for ``applyInArrow``, after each group."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = work(key, table)
        give_back()
        return out

    return run


def lean_cogroup(work: Callable) -> Callable:
    """The same for ``applyInArrow`` of two tables, after each pair of groups."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(key, left, right)
        give_back()
        return out

    return run
