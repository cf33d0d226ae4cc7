"""Several tables that change at one instant.

Each build writes every table to a new folder; one commit then names all of them. A reader takes the folders of
one commit, so it sees all tables of one build or all of another. A build that fails before its commit leaves
folders that nobody reads, and of two builds at a time the second to commit fails whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ledgerloom.sinks.commits import CommitLog
from ledgerloom.sinks.publish import write_checked_parquet

LOG = "_commits"


def commit_log(spark: SparkSession, base: str) -> CommitLog:
    return CommitLog(spark, f"{base.rstrip('/')}/{LOG}")


def publish_together(tables: dict[str, DataFrame], base: str, seen: int | None = None) -> int:
    """Write all ``tables`` and switch to them at once; returns the commit's number.

    ``seen`` is the number the tables were computed from, by default the one at the start of writing.
    """
    base = base.rstrip("/")
    log = commit_log(next(iter(tables.values())).sparkSession, base)
    after = log.version() if seen is None else seen
    build = uuid.uuid4().hex
    held = {}
    for name, df in tables.items():
        _, rows = write_checked_parquet(df, f"{base}/{name}/{build}")
        held[name] = {"folder": f"{name}/{build}", "rows": rows, "schema": df.schema.json()}
    return log.commit(after, {"tables": held})


def read_together(spark: SparkSession, base: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of the last commit, or of commit ``number``."""
    base = base.rstrip("/")
    log = commit_log(spark, base)
    number = log.version() if number is None else number
    if not number:
        raise FileNotFoundError(f"nothing published at {base}")
    held = log.read(number)["tables"]
    return {
        name: spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{base}/{entry['folder']}")
        for name, entry in held.items()
    }
