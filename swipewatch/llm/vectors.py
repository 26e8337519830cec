"""Vectors as packed whole numbers: every component becomes ``floor(scale * x)``, stored as eight-byte floats, exactly.

A row counts when its vector is there and all of its components are finite numbers. Components beyond 2**62 count as that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST = 2 ** 62
TABLE_BYTES = 32 << 20
ROWS_A_TASK = 100_000


def packed(rows: DataFrame, scale: int, vector: str = "vector") -> DataFrame:
    """``rows`` with the array column ``vector`` replaced by its packed form; rows that do not count are left out.
    All other columns go along."""
    others = [c for c in rows.columns if c != vector]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def pack(batches):
        for batch in batches:
            column = batch.column(len(others))
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            edges = np.concatenate([[0], np.cumsum(lengths)])
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            counts = column.is_valid().to_numpy(zero_copy_only=False) & (wrong[edges[1:]] == wrong[edges[:-1]])
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.clip(np.floor(values * scale), -LARGEST, LARGEST)
            bodies = pa.Array.from_buffers(pa.binary(), len(lengths), [
                None, pa.py_buffer((edges * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(whole))])
            made = pa.RecordBatch.from_arrays([*batch.columns[:len(others)], bodies], names=[*others, vector])
            yield made.filter(pa.array(counts))

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), f"`{vector}` binary"])
    return rows.select(*[F.col(f"`{c}`") for c in others], f"`{vector}`").mapInArrow(pack, schema)


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, about ``n`` of them, in tasks of equal numbers: all cores busy, and not more than ``ROWS_A_TASK`` each."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / ROWS_A_TASK)))


def in_tables(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches put together to tables of about so many rows, or of ``TABLE_BYTES`` if that is less."""
    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= rows or size >= TABLE_BYTES:
            yield pa.Table.from_batches(held)
            held, n, size = [], 0, 0
    if n:
        yield pa.Table.from_batches(held)


def matrix(bodies: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """One row a vector, shorter vectors filled up with zeros to the longest or to ``width``."""
    parts = bodies.to_pylist()
    sizes = np.fromiter((len(b) // 8 for b in parts), np.int64, len(parts))
    values = np.frombuffer(b"".join(parts), np.float64)
    width = max(width, int(sizes.max(initial=0)))
    if len(parts) and (sizes == width).all():
        return values.reshape(len(parts), width)
    out = np.zeros((len(parts), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b``, exactly; beyond 2**62 they count as that."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]  # what one of the two does not have is zero
    if width * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2 ** 53:
        return (a @ b.T).astype(np.int64)
    left, right = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b))
    return np.clip(left @ right.T, -LARGEST, LARGEST).astype(np.int64)
