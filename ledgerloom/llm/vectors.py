"""Rows of embeddings as packed matrices inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Whether a vector is not null or empty and holds finite numbers only."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(column) > 0) & ~F.exists(column, odd), F.lit(False))


def matrix(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and double matrix of the batch's vectors, one pair for each number of components."""
    lists = batch.column(column)
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(offsets)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, flat[offsets[rows][:, None] + np.arange(d)]


def packed(x: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    x = np.ascontiguousarray(x)
    return pa.array([r.tobytes() for r in x], pa.binary())


def unpacked(values, kind=np.float64) -> np.ndarray:
    """Matrix of rows that were packed from one width."""
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1) if len(values) else np.zeros((0, 0), kind)


def selected(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).filter(usable("v") & F.col("id").isNotNull())
