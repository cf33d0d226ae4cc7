"""Global running totals, ranks and shares without a single-task window.

An unpartitioned window sends every row to one task. Here the sort order is cut into buckets at
fixed bounds, each bucket is summed on its own and the bucket totals - one row per bucket - give
the offsets. The bounds come from a sample and are baked into the plan as a literal, so a row's
bucket is a pure function of its key: a retried task cannot disagree. The sample steers balance
only; the result is exact for any bounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import percent_of
from ledgerloom.session import materialize

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 16_384
SAMPLES_PER_BUCKET = 16


def _bounds(df: DataFrame, keys: list[str], rows_per_bucket: int) -> list[list[str]]:
    """Bucket bounds as text tuples; at most MAX_BUCKETS, so small enough for the driver."""
    rows = df.count()
    least = min(df.sparkSession.sparkContext.defaultParallelism, 64)
    buckets = min(MAX_BUCKETS, max(least, math.ceil(rows / rows_per_bucket)))
    wanted = buckets * SAMPLES_PER_BUCKET
    fraction = min(1.0, wanted / max(rows, 1))
    sampled = sorted(tuple(r) for r in df.select(*keys).sample(fraction, seed=7).collect())
    step = max(1, len(sampled) // buckets)
    return [[str(v) for v in key] for key in dict.fromkeys(sampled[step::step])]


def _bucket(df: DataFrame, keys: list[str], bounds: list[list[str]]) -> Column:
    """Number of bounds at or below the row's key, found in two short steps."""
    if not bounds:
        return F.lit(0)
    types = [df.schema[k].dataType.simpleString() for k in keys]
    width = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]

    def literal(bound: list[str]) -> str:
        parts = [f"CAST('{_quoted(v)}' AS {t}) AS k{i}" for i, (v, t) in enumerate(zip(bound, types))]
        return f"struct({', '.join(parts)})"

    def array(items: list[str]) -> str:
        return f"array({', '.join(items)})"

    # constant expressions: folded into one literal before anything runs
    fine = F.expr(array([array([literal(b) for b in g]) for g in groups]))
    coarse = F.expr(array([literal(g[0]) for g in groups]))
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    group = F.size(F.filter(coarse, lambda b: b <= key))
    inside = F.size(F.filter(F.try_element_at(fine, group), lambda b: b <= key))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * width + inside)


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def running_sum(
    df: DataFrame,
    keys: list[str],
    value: str,
    out: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    inclusive: bool = True,
) -> DataFrame:
    """Sum of ``value`` over all rows up to this one in ascending, unique, non-null ``keys`` order.

    Runs one count and one sample of the key columns up front.
    """
    bucketed = df.withColumn("__bucket", _bucket(df, keys, _bounds(df, keys, rows_per_bucket)))
    kind = f"decimal(38,{_scale(df, value)})" if _is_decimal(df, value) else df.schema[value].dataType.simpleString()
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("__bucket")
        .agg(F.sum(value).alias("__total"))
        .select("__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).cast(kind).alias("__offset"))
    )
    upto = Window.unboundedPreceding, 0 if inclusive else -1
    within = Window.partitionBy("__bucket").orderBy(*keys).rowsBetween(*upto)
    partial = F.coalesce(F.sum(value).over(within), F.lit(0)).cast(kind)
    # one offset per bucket, MAX_BUCKETS at most: a proven bound for the broadcast
    return (
        bucketed.withColumn("__partial", partial)
        .join(F.broadcast(offsets), "__bucket")
        .withColumn(out, (F.col("__offset") + F.col("__partial")).cast(kind))
        .drop("__bucket", "__partial", "__offset")
    )


def _is_decimal(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() == "decimal"


def _scale(df: DataFrame, column: str) -> int:
    return df.schema[column].dataType.scale


def rank_descending(df: DataFrame, column: str, out: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``RANK() OVER (ORDER BY column DESC NULLS LAST)``: one plus the rows with a larger value.

    Ties are counted before anything is ordered, so a value shared by most rows is one row here.
    ``df`` is computed once and kept in the shared folder for the passes over it.
    """
    rows = materialize(df, "ranked")
    counts = (
        rows.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("__ties"))
        .withColumn("__down", -F.col(column))
    )
    above = running_sum(counts, ["__down"], "__ties", "__above", rows_per_bucket, inclusive=False)
    return (
        rows.join(above.select(column, "__above"), column, "left")
        .withColumn(out, (F.coalesce("__above", rows.agg(F.count(column)).scalar()) + 1).cast("long"))
        .drop("__above")
        .select(*df.columns, out)
    )


def with_percent_of_total(df: DataFrame, column: str, out: str) -> DataFrame:
    """Share of the column's grand total in percent; the total is a one-value subquery."""
    total = df.agg(F.sum(column).alias("total")).scalar()
    return df.withColumn(out, percent_of(F.col(column), total))


def newest(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Top ``limit`` rows by descending keys; each task keeps only ``limit`` rows."""
    return df.orderBy(*[F.desc(k) for k in keys]).limit(limit)
