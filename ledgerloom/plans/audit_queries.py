"""Questions about past runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ordered import newest
from ledgerloom.operators.quality import totals_agree


def latest_runs(run_audit: DataFrame, limit: int = 5) -> DataFrame:
    return newest(run_audit, ["started_at", "run_id"], limit).select("run_id", "status", "status_reason")


def file_reconciliation(file_audit: DataFrame, limit: int = 20) -> DataFrame:
    return newest(file_audit, ["event_ts", "run_id", "source_filename"], limit).select(
        "source_filename", "file_status", "source_rows", "accepted_rows", "rejected_rows"
    )


def gold_against_silver(gold: DataFrame, silver: DataFrame) -> DataFrame:
    return totals_agree(gold, "total_amount", silver, "amount").select(
        F.col("left_total").alias("gold_total"), F.col("right_total").alias("silver_total")
    )


def latest_exceptions(exceptions: DataFrame, limit: int = 20) -> DataFrame:
    return newest(exceptions, ["run_id", "source_filename", "source_row_number"], limit).select(
        "source_filename", "source_row_number", "transaction_id", "rejection_reasons"
    )


def date_disagreements(silver: DataFrame, file_audit: DataFrame) -> DataFrame:
    """Accepted rows whose business date is not the delivery date of their file."""
    files = file_audit.select("run_id", "source_filename", "file_date")
    return (
        silver.join(files, ["run_id", "source_filename"])
        .filter(F.col("transaction_date") != F.col("file_date"))
        .select("transaction_id", "transaction_date", "file_date", "source_filename")
    )
