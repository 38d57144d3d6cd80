"""Embedding columns as whole numbers in numpy, exact sums of them, and distances between centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components beyond it are an error: with them squared distances of vectors don't surely fit a long.
LARGEST = 1 << 27
#: Vectors of one step inside a batch.
ROWS = 2048


def whole_numbers(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept (``dims`` components, all of them finite numbers), and floor(scale * x) of theirs, as int32."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kept = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    values = column.filter(kept).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    kept = kept.to_numpy(zero_copy_only=False).copy()
    finite = np.isfinite(values).all(1)  # a null is NaN here
    kept[kept] = finite
    scaled = np.floor(values[finite] * scale)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ArithmeticError(f"components of up to {LARGEST / scale:g} can be measured exactly")
    return kept, scaled.astype(np.int32)


def packed(x: np.ndarray) -> pa.Array:
    """Rows of ``x`` as binary values."""
    x = np.ascontiguousarray(x)
    width = x.itemsize * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * width), pa.py_buffer(x)])


def unpacked(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    """The inverse of ``packed``."""
    if not len(column):
        return np.zeros((0, dims), kind)
    # a slice of a longer array has its own first offset
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.dtype(kind), count=len(column) * dims, offset=int(offsets[0])).reshape(-1, dims)


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of int64 rows."""
    d = x.astype(np.int64) - y
    return (d * d).sum(-1)


def summed(rows: DataFrame, group: str, values: str) -> dict[int, dict[int, int]]:
    """Componentwise sums of the arrays ``values`` by ``group``: bounded by the numbers of groups and components, whatever the number of rows."""
    each = rows.select(group, F.posexplode(values).alias("at", "x"))
    out: dict[int, dict[int, int]] = {}
    for r in each.groupBy(group, "at").agg(F.sum("x").alias("x")).collect():
        out.setdefault(r[group], {})[r["at"]] = r["x"]
    return out
