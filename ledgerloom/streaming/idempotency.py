"""File-level idempotency: which delivered files are new to us?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# File states.
LOADED, PROCESSED, SKIPPED = "LOADED", "PROCESSED", "SKIPPED_IDENTICAL"


def current_files(events: DataFrame) -> DataFrame:
    """Latest event per run and file of an append-only file log."""
    keys = ["run_id", "source_filename"]
    rest = [c for c in events.columns if c not in keys]
    # LOADED always precedes PROCESSED, also when both carry the same second
    rank = F.when(F.col("file_status") == LOADED, 0).otherwise(1)
    return (
        events.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct("event_ts", rank)).alias("latest"))
        .select(*keys, "latest.*")
    )


def processed_hashes(events: DataFrame) -> DataFrame:
    """Per content hash the earliest run that fully processed it."""
    return (
        events.filter(F.col("file_status") == PROCESSED)
        .groupBy("file_sha256")
        .agg(F.min(F.struct("run_id", "source_filename")).alias("first"))
        .select("file_sha256", F.col("first.run_id").alias("prior_run"), F.col("first.source_filename").alias("prior_file"))
    )


def with_prior_copy(files: DataFrame, events: DataFrame) -> DataFrame:
    """Add ``file_status`` (LOADED or SKIPPED_IDENTICAL) and ``note`` to recognized files.

    Only processed copies count: two identical files that arrive together are both loaded.
    """
    note = F.concat(
        F.lit("identical content already processed as "), "prior_file", F.lit(" in "), "prior_run"
    )
    known = F.col("prior_run").isNotNull()
    return (
        files.join(processed_hashes(events), files.sha256 == F.col("file_sha256"), "left")
        .withColumn("file_status", F.when(known, SKIPPED).otherwise(LOADED))
        .withColumn("note", F.when(known, note))
        .drop("file_sha256", "prior_run", "prior_file")
    )


def loaded_in_run(events: DataFrame, run_id: str) -> DataFrame:
    """Files of this run that wait for validation; leftovers of failed runs are not among them."""
    return current_files(events.filter(F.col("run_id") == run_id)).filter(F.col("file_status") == LOADED)
