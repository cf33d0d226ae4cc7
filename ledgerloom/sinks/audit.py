"""Append-only run and file logs; the current status is the latest event."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.schemas import FILE_EVENT, RUN_EVENT
from ledgerloom.sinks.publish import read_or_empty

# Run states.
RUNNING, SUCCESS, FAILED = "RUNNING", "SUCCESS", "FAILED"


def utc_now() -> datetime:
    """Now in UTC to the second; one literal per run, never evaluated on executors."""
    return datetime.now(timezone.utc).replace(microsecond=0)


def utc_text(column) -> F.Column:
    """Timestamp as ISO text with a trailing Z."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def new_run_id() -> str:
    return f"RUN_{datetime.now(timezone.utc):%Y%m%dT%H%M%S}_{uuid.uuid4().hex[:6]}"


def append_run_event(spark: SparkSession, path: str, run_id: str, status: str, reason: str | None = None) -> None:
    spark.createDataFrame([(run_id, status, reason, utc_now())], RUN_EVENT).coalesce(1).write.mode(
        "append"
    ).parquet(path)


def append_file_events(events: DataFrame, path: str) -> None:
    """``events`` has the FILE_EVENT columns except event_ts."""
    stamped = events.withColumn("event_ts", F.lit(utc_now()))
    stamped.select(*[F.col(f.name).cast(f.dataType) for f in FILE_EVENT.fields]).write.mode("append").parquet(path)


def run_events(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, RUN_EVENT)


def file_events(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, FILE_EVENT)


def run_audit(events: DataFrame) -> DataFrame:
    """One row per run: started_at, finished_at, status, status_reason."""
    final = F.col("status") != RUNNING
    order = F.struct("event_ts", F.when(final, 1).otherwise(0))
    return events.groupBy("run_id").agg(
        F.min("event_ts").alias("started_at"),
        F.max(F.when(final, F.col("event_ts"))).alias("finished_at"),
        F.max_by("status", order).alias("status"),
        F.max_by("status_reason", order).alias("status_reason"),
    )
