"""What the vector operators share: valid vectors, packed rows, the rotation to principal dimensions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, with zeros up to the width."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes, sizes)
    out[row, at] = flat
    return out


def valid(lists: pa.Array) -> np.ndarray:
    """Of each row whether it isn't null and holds no component that is null or not finite."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    bad = ~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64))
    sums = np.concatenate([[0], np.cumsum(bad)])
    ends = np.cumsum(sizes)
    return lists.is_valid().to_numpy(zero_copy_only=False) & (sums[ends] == sums[ends - sizes])


def list_column(m: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).ravel()))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square is lost or overflows."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def width_of(rows: DataFrame, column: str) -> int:
    return int(rows.agg(F.max(F.size(column))).first()[0] or 0)


def rotation(rows: DataFrame, column: str, width: int, prepare: Callable[[np.ndarray], np.ndarray] = lambda m: m) -> np.ndarray:
    """Singular vectors of all rows, leading first: sums of outer products by task, then in 16 groups, then on the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gram = np.zeros((width, width))
        for b in batches:
            m = prepare(matrix(b.column(0), width))
            gram += m.T @ m
        yield pa.RecordBatch.from_pydict({"g": [TaskContext.get().partitionId() % 16], "gram": [gram.tobytes()]})

    def total(key, t):
        return pa.table({"gram": [sum(np.frombuffer(x, np.float64) for x in t.column("gram").to_pylist()).tobytes()]})

    sums = rows.select(column).mapInArrow(part, "g long, gram binary").groupBy("g").applyInArrow(total, "gram binary").collect()
    gram = sum((np.frombuffer(r[0], np.float64) for r in sums), np.zeros(width * width)).reshape(width, width)
    if not np.isfinite(gram).all():  # any rotation is right, only a good one saves work
        return np.eye(width)
    return np.linalg.eigh(gram / max(np.abs(gram).max(initial=0), 1e-300))[1][:, ::-1].copy()
