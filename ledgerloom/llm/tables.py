"""Small helpers shared by the operators: reading, gapless numbers and prefix sums over hot keys, sizes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialize

ROWS_PER_SLICE = 20_000
LEAST_SLICES = 256
WIDE_ROWS = 1_000
BROADCAST_ROWS = 1_000_000  # of two numbers: 16 MB


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches to Python of at most ``rows`` rows for what runs inside, where rows are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize_wide(df: DataFrame, label: str) -> DataFrame:
    """Like :func:`materialize`, for steps whose Python tasks take texts, sets or bitmaps."""
    with arrow_rows(df.sparkSession, WIDE_ROWS):
        return materialize(df, label)


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``BROADCAST_ROWS`` rows; beyond that Catalyst joins it by shuffle.

    For narrow tables that lie in the shared folder, where the count reads no column.
    """
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def slices_for(rows: int) -> int:
    """Slices that keep a slice near ``ROWS_PER_SLICE`` rows even if one key has every row."""
    return max(LEAST_SLICES, math.ceil(rows / ROWS_PER_SLICE))


def hash_slice(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(slices)).cast("int")


def prefix(df: DataFrame, by: list[str], slice_column: str, order: list[str], value: str, out: str) -> DataFrame:
    """``out``: sum of ``value`` over the rows of the same ``by`` up to and with this one.

    Rows are ordered by slice, then by ``order`` within it; rows that tie in ``order`` count together.
    No task holds a whole key: a slice is summed on its own and the slice totals give the offsets.
    ``by`` columns must not be null.
    """
    keys = [*by, slice_column]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__v"))
    earlier = Window.partitionBy(*by).orderBy(slice_column).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("__v").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.withColumn("__within", F.sum(value).over(within))
        .join(offsets, keys)
        .withColumn(out, F.col("__before") + F.col("__within"))
        .drop("__within", "__before")
    )


def number(df: DataFrame, by: list[str], slice_column: str, order: list[str], out: str) -> DataFrame:
    """``out``: gapless numbers from 0 within ``by``; ``by`` columns must not be null."""
    keys = [*by, slice_column]
    totals = df.groupBy(*keys).agg(F.count("*").alias("__v"))
    earlier = Window.partitionBy(*by).orderBy(slice_column).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("__v").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__within", F.row_number().over(within) - 1)
        .join(offsets, keys)
        .withColumn(out, (F.col("__before") + F.col("__within")).cast("long"))
        .drop("__within", "__before")
    )


__all__ = ["hash_slice", "materialize", "materialize_wide", "number", "prefix", "read", "slices_for", "small"]
