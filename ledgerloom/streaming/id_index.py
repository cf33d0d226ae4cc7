"""Which of these ids were accepted before? An index that a new batch asks without reading all of history.

Ids of a run lie in ``buckets`` folders by hash, and each bucket of a run has a Bloom filter: 64-bit blocks with
``PROBES`` bits per id, kept as a table (bucket, block, bits). A batch is first held against the filters of all
runs at once, which are 4 bytes per accepted id; what passes - true repeats and a few in ten thousand others -
names the buckets of the runs it may lie in, and only their files are opened. The result is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import materialize
from ledgerloom.sinks.publish import read_or_empty

BUCKETS = 64
BITS_PER_ID = 32
PROBES = 5
ROWS_PER_FILE = 5_000_000

IDS = "id string"
FILTERS = "bucket int, width long, block long, bits long, run_id string"


class IdIndex:
    """Index below ``home``. Runs are added whole and count once the caller names them as committed."""

    def __init__(self, spark: SparkSession, home: str, buckets: int = BUCKETS) -> None:
        self.spark, self.home, self.buckets = spark, home.rstrip("/"), buckets

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _block(key: Column, width: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(1)), width)

    @staticmethod
    def _mask(key: Column) -> Column:
        h = F.xxhash64(key, F.lit(2))
        bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(PROBES)]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    def add(self, run_id: str, ids: DataFrame) -> None:
        """Add the ids of a run: one column of text without NULLs, each id once."""
        own = materialize(ids.select(F.col(ids.columns[0]).cast("string").alias("id")), "index-ids")
        n = own.count()
        if not n:
            return
        width = 1 << max(0, (n * BITS_PER_ID // (64 * self.buckets)).bit_length())
        placed = own.withColumn("bucket", self._bucket(F.col("id")))
        # a bucket has even shares by hash; large ones are cut into several files
        files = -(-n // (self.buckets * ROWS_PER_FILE))
        slot = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(files))
        dealt = placed.repartition(min(self.buckets * files, max(1, n // 1000)), "bucket", slot)
        dealt.write.mode("append").partitionBy("bucket").parquet(f"{self.home}/ids/run_id={run_id}")
        blocks = placed.groupBy("bucket", self._block(F.col("id"), F.lit(width)).alias("block")).agg(F.bit_or(self._mask(F.col("id"))).alias("bits"))
        filters = blocks.select("bucket", F.lit(width).cast("long").alias("width"), "block", "bits", F.lit(run_id).alias("run_id"))
        filters.write.mode("append").partitionBy("run_id").parquet(f"{self.home}/filters")

    def candidates(self, ids: DataFrame, runs: DataFrame) -> tuple[DataFrame, list[tuple[str, int]]]:
        """(ids that pass the filters with bucket, folders they may lie in as (run, bucket)).

        Folders reach the driver as the names they are: runs times buckets at most.
        """
        filters = read_or_empty(self.spark, f"{self.home}/filters", self.spark.createDataFrame([], FILTERS).schema)
        filters = filters.join(runs.select("run_id").distinct(), "run_id", "left_semi")
        # widths are powers of two: a few dozen numbers however many runs there are
        widths = [r["width"] for r in filters.select("width").distinct().collect()]
        key = F.col("id")
        probes = ids.select(F.col(ids.columns[0]).cast("string").alias("id")).filter(key.isNotNull()).distinct()
        probes = probes.select("id", self._bucket(key).alias("bucket"), self._mask(key).alias("mask"), F.explode(F.array(*[F.lit(w) for w in widths]).cast("array<long>")).alias("width"))
        probes = probes.withColumn("block", self._block(key, F.col("width")))
        merged = filters.groupBy("width", "bucket", "block").agg(F.bit_or("bits").alias("bits"))
        place = ["width", "bucket", "block"]
        passed = F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")
        maybe = materialize(probes.join(merged, place).filter(passed).drop("bits"), "index-maybe")
        if maybe.isEmpty():
            return maybe.select("id", "bucket"), []
        found = filters.join(maybe, place).filter(passed).select("run_id", "bucket").distinct().collect()
        return maybe.select("id", "bucket").distinct(), sorted((r["run_id"], r["bucket"]) for r in found)

    def seen(self, ids: DataFrame, runs: DataFrame) -> DataFrame:
        """Those of ``ids`` (one column of text) that a run of ``runs`` (column run_id) has added; column ``id``."""
        maybe, folders = self.candidates(ids, runs)
        if not folders:
            return maybe.select("id").limit(0)
        paths = [f"{self.home}/ids/run_id={run}/bucket={bucket}" for run, bucket in folders]
        return self.spark.read.schema(IDS).parquet(*paths).join(maybe.select("id"), "id", "left_semi").distinct()
