"""Ordered upsert with a stale guard: corrections overwrite, older files cannot undo them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.joins import with_unknown_flag
from ledgerloom.operators.rules import normalized
from ledgerloom.schemas import TRANSACTION_COLUMNS
from ledgerloom.session import materialize
from ledgerloom.streaming.dedup import scattered
from ledgerloom.streaming.keyed_table import KeyedTable

# Outcome names.
INSERTED, UPDATED, UNCHANGED = "inserted", "updated", "unchanged"
STALE, REJECTED = "skipped_stale", "rejected"
OUTCOMES = [INSERTED, UPDATED, UNCHANGED, STALE, REJECTED]

STATE = [c for c in TRANSACTION_COLUMNS if c != "transaction_id"] + ["source_file"]
ROWS_PER_CHUNK = 1_000_000


def stored_key(readable: Column) -> Column:
    """Key by which a row meets its stored state. Unreadable rows are scattered: one NULL key would be one task's work."""
    return F.when(readable, F.col("transaction_id")).otherwise(scattered(F.col("source_file"), F.col("row_no")))


def flag_rows(target: DataFrame, batch: DataFrame, accounts: DataFrame) -> DataFrame:
    """The normalized batch with ``stored`` state, ``stale`` and ``writes``, written to the shared folder once.

    ``batch`` is all text plus source_file and row_no (position in its file). A row of an older file
    than the stored one is stale. A row that would be written but names an unknown account is rejected.
    """
    rows = with_unknown_flag(normalized(batch), accounts, "account_id", "unknown_account")
    ids = rows.select("transaction_id").distinct()
    stored = target.join(ids, "transaction_id", "left_semi").select(
        F.col("transaction_id").alias("__stored_id"), F.struct(*STATE).alias("stored")
    )
    # an unreadable row has no stored state to meet, and a blank id shared by many is no join key
    readable = F.col("reject_reason").isNull()
    rows = rows.withColumn("__key", stored_key(readable))
    rows = rows.join(stored, F.col("__key") == F.col("__stored_id"), "left").drop("__key", "__stored_id")
    stale = readable & F.coalesce(F.col("source_file") < F.col("stored.source_file"), F.lit(False))
    flagged = rows.withColumns(
        {"stale": stale, "writes": readable & ~stale & ~F.col("unknown_account") & F.col("account_id").isNotNull()}
    )
    return materialize(flagged.drop("unknown_account"), "batch")


def classify(
    target: DataFrame, batch: DataFrame, accounts: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """What every batch row does to ``target``: adds ``outcome`` and ``writes``."""
    return outcomes(flag_rows(target, batch, accounts), rows_per_chunk)


def outcomes(flagged: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """``outcome`` of every flagged row; rows count in (source_file, row_no) order.

    ``unchanged`` compares all columns including source_file. Only rows that write take part in the
    search for a predecessor. It runs in two steps, so no id is ever one task's work: inside a chunk
    of one file (bounded by ``rows_per_chunk``), and between chunks, where an id has one row per file
    chunk at most.
    """
    shown = ["transaction_id", *STATE, "row_no", "reject_reason", "writes", "outcome"]
    idle = flagged.filter(~F.col("writes")).withColumn("outcome", F.when(F.col("stale"), STALE).otherwise(REJECTED))
    rows = flagged.filter("writes").withColumns(
        {"state": F.struct(*STATE), "chunk": F.floor(F.col("row_no") / rows_per_chunk)}
    )
    spot = ["transaction_id", "source_file", "chunk"]
    inside = Window.partitionBy(*spot).orderBy("row_no")
    between = Window.partitionBy("transaction_id").orderBy("source_file", "chunk")
    ends = (
        rows.groupBy(*spot)
        .agg(F.max_by("state", "row_no").alias("end"))
        .select(*spot, F.lag("end").over(between).alias("carried"))
        .filter(F.col("carried").isNotNull())
    )
    rows = rows.withColumn("near", F.lag("state").over(inside)).join(ends, spot, "left")
    prior = F.coalesce("near", "carried", "stored")
    outcome = (
        F.when(prior.isNull(), INSERTED).when(prior.eqNullSafe(F.col("state")), UNCHANGED).otherwise(UPDATED)
    )
    return rows.withColumn("outcome", outcome).select(*shown).unionByName(idle.select(*shown))


def last_writes(flagged: DataFrame) -> DataFrame:
    """Per id the last row that writes, in (source_file, row_no) order: transaction_id and its state."""
    return (
        flagged.filter("writes")
        .groupBy("transaction_id")
        .agg(F.max_by(F.struct(*STATE), F.struct("source_file", "row_no")).alias("state"))
        .select("transaction_id", "state.*")
    )


def upsert_batch(table: KeyedTable, batch: DataFrame, accounts: DataFrame) -> tuple[DataFrame, int]:
    """Bring a batch into the stored table: (flagged rows for :func:`outcomes`, number of the commit).

    Only buckets that hold ids of the batch are read, only those with an id that is written are rewritten. The
    commit fails if the table has moved on since the batch was judged.
    """
    seen = table.log.version()
    ids = normalized(batch).select("transaction_id").filter("transaction_id IS NOT NULL")
    flagged = flag_rows(table.read_for(ids), batch, accounts)
    return flagged, table.upsert(last_writes(flagged), seen)


def merged(target: DataFrame, flagged: DataFrame) -> DataFrame:
    """``target`` after the batch: per id the last write in (source_file, row_no) order.

    ``flagged`` is what :func:`flag_rows` or :func:`classify` gives; the former is cheaper.
    """
    last = last_writes(flagged)
    kept = target.join(last.select("transaction_id"), "transaction_id", "left_anti")
    return kept.select("transaction_id", *STATE).unionByName(last)


def outcome_counts(classified: DataFrame) -> DataFrame:
    """One row per file with the number of rows per outcome."""
    counts = [F.count_if(F.col("outcome") == name).alias(name) for name in OUTCOMES]
    return classified.groupBy("source_file").agg(*counts)
