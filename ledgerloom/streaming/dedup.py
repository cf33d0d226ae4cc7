"""Named policies for repeated ids. The policies disagree on purpose; pick one by name.

None of them uses a window over an id. Repeated ids are found by a grouped aggregate, which folds a
hot id on the map side (ids that occur once cross the network), and only the repeated ones are written
to the shared folder and joined back. Their
true size is known then: few repeats are broadcast and the rows stay where they are; many are
joined by shuffle, where AQE splits a hot id over tasks. Each policy runs that job when called.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import is_missing
from ledgerloom.operators.ordered import running_sum
from ledgerloom.session import materialize

LEAST_SPREAD = 1024


def spread_missing(key: Column, *salt: Column) -> Column:
    """Join key that scatters missing ids over many tasks; such a key matches nothing."""
    return F.when(~is_missing(key), key).otherwise(scattered(*salt))


def scattered(*salt: Column) -> Column:
    """Join key of a row that has none: one of four slots a task, chosen by ``salt``."""
    tasks = int(SparkSession.active().conf.get("spark.sql.shuffle.partitions"))
    slot = F.pmod(F.xxhash64(*salt), F.lit(max(LEAST_SPREAD, 4 * tasks))).cast("string")
    return F.concat(F.lit("\x00missing\x00"), slot)


class Places:
    """Numbers for the rows of a batch that sort as ``order`` does: the number of the row's file, then its row number.

    The last column of ``order`` is the row number, a BIGINT; the others name the file and are not null. Where file
    and row number fit, a place is one BIGINT that holds both, and between :meth:`pack` and :meth:`unpack` a row
    carries nothing else of them; otherwise it is a DECIMAL beside both. The list of files is small next to the
    rows; its true size lets Catalyst broadcast it.
    """

    def __init__(self, df: DataFrame, order: list[str]) -> None:
        *self.file, self.row = order
        row = F.col(self.row)
        found = df.groupBy(*self.file).agg(F.min(row).alias("least"), F.max(row).alias("most"), F.count_if(row.isNull()).alias("none"))
        files = materialize(found.dropna(subset=self.file), "places")
        one = files.select(*self.file, F.lit(1).cast("long").alias("__one"))
        self.files = materialize(running_sum(one, self.file, "__one", "__file").drop("__one"), "place-numbers")
        seen = files.agg(F.count("*").alias("files"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("none").alias("none")).first()
        self.bits = None if seen.least is None else int(seen.most).bit_length()
        if self.bits is not None and (seen.none or seen.least < 0 or seen.files.bit_length() + self.bits > 63):
            self.bits = None

    def pack(self, df: DataFrame, out: str) -> DataFrame:
        """Add ``out``; the columns of ``order`` go, or their file's number stays where ``out`` cannot hold it."""
        numbered = df.join(self.files, self.file).drop(*self.file)
        if self.bits is not None:
            place = F.shiftleft(F.col("__file"), self.bits).bitwiseOR(F.col(self.row))
            return numbered.withColumn(out, place).drop("__file", self.row)
        number = F.col("__file").cast("decimal(18,0)") * F.lit(Decimal(10**19)).cast("decimal(20,0)")
        place = (number.cast("decimal(37,0)") + F.col(self.row).cast("decimal(19,0)")).cast("decimal(38,0)")
        return numbered.withColumn(out, place)

    def unpack(self, df: DataFrame, place: str) -> DataFrame:
        """The columns of ``order`` instead of ``place``."""
        if self.bits is not None:
            row = F.col(place).bitwiseAND(F.lit((1 << self.bits) - 1))
            df = df.withColumns({"__file": F.shiftright(F.col(place), self.bits), self.row: row})
        return df.join(self.files, "__file").drop("__file", place)


def all_copies_invalid(df: DataFrame, key: str, flag: str) -> DataFrame:
    """Flag every row whose non-null key occurs more than once, the first one included."""
    repeated = materialize(
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("__key"))
        .agg(F.count("*").alias("__n"))
        .filter(F.col("__n") > 1),
        "repeated",
    )
    return (
        df.join(repeated, F.col(key) == F.col("__key"), "left")
        .withColumn(flag, F.col("__n").isNotNull())
        .drop("__key", "__n")
    )


def first_accepted_wins(
    df: DataFrame,
    key: str,
    acceptable: Column,
    order: list[str],
    flag: str,
    accepted_before: DataFrame | None = None,
) -> DataFrame:
    """Flag rows whose key was already accepted, in an earlier run or earlier in this order.

    A row is accepted when ``acceptable`` holds and it is not flagged. So within one key the
    earliest acceptable row wins and every later row, acceptable or not, is a repeat, while rows
    before it are not. ``order`` must be unique per row within a key.
    ``accepted_before`` holds the ids accepted by earlier runs in column ``key``.
    """
    # a single column keeps its minimum in a hash aggregate; a struct would be sorted
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    winners = materialize(
        df.filter(~is_missing(F.col(key)))
        .groupBy(F.col(key).alias("__key"))
        .agg(F.count("*").alias("__n"), F.min(F.when(acceptable, position)).alias("__first"))
        .filter((F.col("__n") > 1) & F.col("__first").isNotNull())
        .select("__key", "__first"),
        "winners",
    )
    # the id moves once, as the join key; a missing one beside it
    missing = is_missing(F.col(key))
    keyed = df.withColumns(
        {"__join": spread_missing(F.col(key), *[F.col(c) for c in order]), "__missing": missing, "__lost": F.when(missing, F.col(key))}
    ).drop(key)
    joined = keyed.join(winners, F.col("__join") == F.col("__key"), "left")
    repeat = F.coalesce(position > F.col("__first"), F.lit(False))
    if accepted_before is not None:
        # only ids of this batch matter: the far larger history is scanned, not shuffled,
        # whenever the batch is small enough to broadcast
        batch_ids = df.select(key).filter(~is_missing(F.col(key))).distinct()
        seen = materialize(accepted_before.select(key).join(batch_ids, key, "left_semi").distinct(), "seen")
        joined = joined.join(seen.select(F.col(key).alias("__seen")), F.col("__join") == F.col("__seen"), "left")
        repeat = repeat | F.col("__seen").isNotNull()
    joined = joined.withColumns({flag: repeat, key: F.when(F.col("__missing"), F.col("__lost")).otherwise(F.col("__join"))})
    return joined.select(*df.columns, flag)


def repeats_in_order(df: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """Flag every occurrence of a non-missing key after the first one in ``order``."""
    return first_accepted_wins(df, key, F.lit(True), order, flag)
