"""Report and split outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sinks.publish import current_csv, publish, read_current, write_csv

# Report columns and output names.
REPORT_COLUMNS = ["branch_id", "transaction_count", "gross_amount", "net_cash_flow"]
VALID_OUTPUT = "valid_transactions.csv"
INVALID_OUTPUT = "invalid_transactions.csv"
METRIC_OUTPUT = "DQsummary.csv"
REPORT_OUTPUT = "branch_summary.csv"


def split_outputs(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without verdict columns, invalid rows with ``error_reason``)."""
    valid = validated.filter("is_valid").drop("reasons", "error_reason", "is_valid")
    invalid = validated.filter(~F.col("is_valid")).drop("reasons", "is_valid")
    return valid, invalid


def write_split(validated: DataFrame, base: str) -> None:
    valid, invalid = split_outputs(validated)
    write_csv(valid, f"{base}/{VALID_OUTPUT}")
    write_csv(invalid, f"{base}/{INVALID_OUTPUT}")


def report_totals(summary: DataFrame) -> DataFrame:
    """(rows, transaction_count, net_cash_flow) of a branch summary."""
    return summary.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum("transaction_count"), F.lit(0)).cast("long").alias("transaction_count"),
        F.coalesce(F.sum("net_cash_flow"), F.lit(0)).alias("net_cash_flow"),
    )


def write_branch_report(summary: DataFrame, base: str, version: str | None = None) -> dict:
    """Publish the ordered report and give its totals, taken from the written rows.

    A reader sees the old report or the new one. ``path`` is the folder of the CSV.
    """
    home, spark = f"{base.rstrip('/')}/{REPORT_OUTPUT}", summary.sparkSession
    publish(summary.select(*REPORT_COLUMNS), home, version or f"v-{uuid.uuid4().hex}", ["branch_id"], ["branch_id"])
    totals = report_totals(read_current(spark, home)).first()
    return {
        "path": current_csv(spark, home),
        "rows": totals["rows"],
        "transaction_count": totals["transaction_count"],
        "net_cash_flow": float(totals["net_cash_flow"]),
    }
