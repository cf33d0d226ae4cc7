"""A stored table laid out so that one key opens one file.

Rows lie in ranges of the key, sorted inside a file, in row groups with Bloom filters and a page index on the key.
A list of the files' least and greatest keys is written last: a lookup reads that list - one row per file - and opens
the files whose range holds the key, instead of every footer of the folder. A table without its list is unfinished.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import materialize

ROWS_PER_FILE = 1_000_000
ROW_GROUP_BYTES = 16 << 20
RANGES = "ranges"
ROWS = "rows"


def write_for_lookup(df: DataFrame, base: str, key: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write ``df`` below ``base``, a folder of its own. Rows whose key is NULL are kept and never found.

    All rows of one key lie in one file: meant for keys that are unique or nearly so.
    """
    spark = df.sparkSession
    rows = materialize(df, "lookup-rows")
    files = max(1, -(-rows.count() // rows_per_file))
    (
        rows.repartitionByRange(files, key)
        .sortWithinPartitions(key)
        .write.option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", str(rows_per_file))
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .parquet(f"{base}/{ROWS}")
    )
    stored = spark.read.schema(df.schema).parquet(f"{base}/{ROWS}")
    ranges = (
        stored.filter(F.col(key).isNotNull())
        .select(F.col("_metadata.file_path").alias("file"), F.col(key).alias("key"))
        .groupBy("file")
        .agg(F.min("key").alias("least"), F.max("key").alias("greatest"))
    )
    ranges.coalesce(1).write.parquet(f"{base}/{RANGES}")


def look_up(spark: SparkSession, base: str, key: str, value: object) -> DataFrame:
    """The rows whose key is ``value``; no row when there is none, or when ``value`` is None."""
    wanted = F.lit(value)
    held = spark.read.parquet(f"{base}/{RANGES}").filter(wanted.between(F.col("least"), F.col("greatest")))
    # one file, or a few where a file's last key is the next one's first
    files = [r["file"] for r in held.select("file").collect()]
    if not files:
        return spark.read.parquet(f"{base}/{ROWS}").limit(0)
    return spark.read.parquet(*files).filter(F.col(key) == wanted)
