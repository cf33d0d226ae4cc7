"""Set operators on whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGES = 1024


def stack(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames, duplicates kept; a column missing in one frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _fingerprints(df: DataFrame, cols: list[str], ranges: int) -> DataFrame:
    """One row per hash range: rows and two order-free sums of 64-bit row hashes.

    A hash is summed in three digits of 22 bits, so no sum overflows below two trillion rows whatever the
    session says. A NULL counts by its column.
    """
    parts = [part for c in cols for part in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    hashes = [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)]
    low = F.lit((1 << 22) - 1)
    digits = [F.shiftrightunsigned(h, s).bitwiseAND(low) for h in hashes for s in (0, 22, 44)]
    hashed = df.select(F.pmod(hashes[0], F.lit(ranges)).cast("int").alias("range"), *[d.alias(f"d{i}") for i, d in enumerate(digits)])
    sums = [F.sum(f"d{i}").alias(f"d{i}") for i in range(len(digits))]
    return hashed.groupBy("range").agg(F.count("*").alias("rows"), *sums)


def differing_ranges(left: DataFrame, right: DataFrame, ranges: int = RANGES) -> list[int]:
    """Hash ranges in which two tables differ as multisets; runs a job that moves ``ranges`` short rows a task at most."""
    cols = left.columns
    ours, theirs = (_fingerprints(df.select(*[F.col(f"`{c}`") for c in cols]), cols, ranges) for df in (left, right))
    values = [c for c in ours.columns if c != "range"]
    both = ours.withColumn("side", F.lit(1)).unionByName(theirs.withColumn("side", F.lit(0)))
    same = both.groupBy("range").agg(F.count("*").alias("n"), *[F.count_distinct(v).alias(v) for v in values])
    wrong = (F.col("n") != 2) | reduce(lambda a, b: a | b, [F.col(v) != 1 for v in values])
    return sorted(r["range"] for r in same.filter(wrong).select("range").collect())


def multiset_difference(left: DataFrame, right: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Rows by which two tables differ, with the side that has the surplus: (…columns, left_rows, right_rows).

    Tables are first compared by fingerprints of ``ranges`` hash ranges, 128 bits each, in one pass that shuffles no
    row. Only rows of ranges that differ are then grouped, once per side, so equal tables end after that pass and a
    row repeated a billion times travels as one.
    """
    cols = left.columns
    wrong = differing_ranges(left, right, ranges)
    parts = [part for c in cols for part in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    within = F.pmod(F.xxhash64(*parts), F.lit(ranges)).cast("int").isin(wrong) if wrong else F.lit(False)
    ours = left.filter(within).groupBy(*cols).agg(F.count("*").alias("left_rows"), F.lit(0).cast("long").alias("right_rows"))
    theirs = right.select(*cols).filter(within).groupBy(*cols).agg(
        F.lit(0).cast("long").alias("left_rows"), F.count("*").alias("right_rows")
    )
    return (
        ours.unionByName(theirs)
        .groupBy(*cols)
        .agg(F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows"))
        .filter(F.col("left_rows") != F.col("right_rows"))
    )


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Equal as multisets? Runs a job that shuffles fingerprints only, unless values of different types have to be compared."""
    return not differing_ranges(left, right) or multiset_difference(left, right).isEmpty()
