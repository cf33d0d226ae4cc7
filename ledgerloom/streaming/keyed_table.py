"""A table with a key, in hash buckets: a batch rewrites the buckets it touches and no other file.

A commit names the folder of every bucket. Readers follow the last commit, so they see a batch whole or not at
all; a writer that meets another writer's commit fails and leaves the table as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.session import materialize
from ledgerloom.sinks.commits import CommitLog

BUCKETS = 64


class KeyedTable:
    """Rows with a unique, non-null ``key`` below ``home``. ``buckets`` is fixed by the first write."""

    def __init__(self, spark: SparkSession, home: str, key: str, schema: StructType, buckets: int = BUCKETS) -> None:
        self.spark, self.home, self.key, self.schema = spark, home.rstrip("/"), key, schema
        self.log = CommitLog(spark, f"{self.home}/_commits")
        known = self.log.latest()
        self.buckets = known["buckets"] if known else buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def folders(self) -> dict[int, str]:
        """Folder of every bucket that has rows."""
        known = self.log.latest()
        return {int(b): folder for b, folder in known["folders"].items()} if known else {}

    def _read(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.home}/{f}" for f in folders.values()])

    def read(self) -> DataFrame:
        return self._read(self.folders())

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets in which rows of these keys lie: at most ``buckets`` numbers."""
        return sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())

    def read_for(self, keys: DataFrame) -> DataFrame:
        """Rows of the buckets that hold these keys; nothing else is opened."""
        own = set(self.touched(keys))
        return self._read({b: f for b, f in self.folders().items() if b in own})

    def upsert(self, changes: DataFrame, seen: int | None = None) -> int:
        """Put rows in place of those of the same key, or beside the others; returns the commit's number.

        ``changes`` has each key once. ``seen`` is the commit they were computed from, by default the present one.
        Nothing is committed for an empty batch.
        """
        after = self.log.version() if seen is None else seen
        before = self.log.read(after)["folders"] if after else {}
        rows = materialize(changes.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]), "changes")
        touched = self.touched(rows)
        if not touched:
            return after
        old = self._read({b: before[str(b)] for b in touched if str(b) in before})
        kept = old.join(rows.select(self.key), self.key, "left_anti")
        batch = f"data/{uuid.uuid4().hex}"
        whole = kept.select(*self.schema.fieldNames()).unionByName(rows).withColumn("__bucket", self._bucket())
        whole.repartition(len(touched), "__bucket").write.partitionBy("__bucket").parquet(f"{self.home}/{batch}")
        folders = {**before, **{str(b): f"{batch}/__bucket={b}" for b in touched}}
        return self.log.commit(after, {"buckets": self.buckets, "folders": folders})
