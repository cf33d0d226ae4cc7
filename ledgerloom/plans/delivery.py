"""Branch delivery check: many branch files -> valid rows, invalid rows and a metric table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.quality import metric_table
from ledgerloom.operators.rules import REPEATED_ID, value_rules, with_verdict
from ledgerloom.session import materialize
from ledgerloom.sinks.publish import write_csv
from ledgerloom.sinks.reports import METRIC_OUTPUT, write_split
from ledgerloom.sources.branch_files import read_branch_files
from ledgerloom.streaming.dedup import all_copies_invalid


@dataclass(frozen=True)
class Delivery:
    validated: DataFrame
    files: DataFrame
    metrics: DataFrame


def validate_all(rows: DataFrame) -> DataFrame:
    """All seven rules on every row; a repeated id makes every copy invalid."""
    flagged = all_copies_invalid(rows, "transaction_id", "__repeated")
    return with_verdict(flagged, [*value_rules(), (REPEATED_ID, F.col("__repeated"))]).drop("__repeated")


def files_read(validated: DataFrame, files: DataFrame) -> DataFrame:
    """(file, row_count) of every readable file, 0 for one with a header only."""
    counted = validated.groupBy("source_file").agg(F.count("*").alias("n"))
    return (
        files.filter(F.col("error").isNull())
        .join(counted, F.col("file") == F.col("source_file"), "left")
        .select("file", F.coalesce("n", F.lit(0)).alias("row_count"))
    )


def check_delivery(spark: SparkSession, folder: str) -> Delivery:
    """Read and judge a folder of branch files. The verdicts are written once and used thrice."""
    rows, files = read_branch_files(spark, folder)
    validated = materialize(validate_all(rows), "validated")
    return Delivery(validated, files, metric_table(validated, files.select("file", "error"), REPEATED_ID))


def publish_delivery(delivery: Delivery, base: str) -> None:
    """Valid and invalid rows and the metrics, each as a CSV folder; a rerun replaces them."""
    write_split(delivery.validated, base)
    write_csv(delivery.metrics, f"{base}/{METRIC_OUTPUT}")
