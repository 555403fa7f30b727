"""Usable vectors: checked, scaled to length one, one row per id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` elements, all finite, not all 0; false for null."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def usable_rows(df: DataFrame, row_id: str, vec: str, dim: int) -> DataFrame:
    """(id, vec): all rows with an id and a usable vector, as delivered."""
    return df.select(F.col(row_id).cast("long").alias("id"), F.col(vec).alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec"), dim))


def unit_vectors(df: DataFrame, row_id: str, vec: str, dim: int) -> DataFrame:
    """(id, vec): one row for each id with a usable vector, scaled to length one.

    Rows delivered again carry the same vector; should they differ, the first in
    the order of the arrays is taken.  Vectors that are not usable, and null ids,
    are left out.
    """
    rows = usable_rows(df, row_id, vec, dim)
    rows = rows.groupBy("id").agg(F.min("vec").alias("vec"))
    return unit(rows)


def unit(rows: DataFrame) -> DataFrame:
    """(id, vec) scaled to length one, in single precision."""
    schema = "id long, vec array<float>"

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"id": b.column("id"), "vec": arrow_vectors(unit_rows(matrix(b.column("vec"))))})

    return rows.select("id", "vec").mapInArrow(scale, schema)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """The rows scaled to length one, in single precision."""
    x = x.astype(np.float64)
    if len(x):
        # Sums of squares of floats can leave the range of a float: scale by the largest magnitude first.
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x.astype(np.float32)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix; no row gives an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), flat.dtype)


def arrow_vectors(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, dtype=np.float32)
    offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if len(x) else np.zeros(1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))


def stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1), np.float32)
