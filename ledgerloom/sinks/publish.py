"""Publish a table so that readers see the old version or the new one, never a mixture.

Each version is written to its own folder and checked; a one-line pointer file, renamed into place
last, names the current one. Any failure before that leaves the pointer, and so the readers, alone.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINTER = "CURRENT"
PUBLISHED = "_PUBLISHED"

# doubled quotes, values with their own white space, empty text and NULL both as nothing
CSV_FORMAT = {
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path, JVM) of a path of any scheme."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target, jvm


def path_exists(spark: SparkSession, path: str) -> bool:
    store, target, _ = hadoop_path(spark, path)
    return store.exists(target)


def _write_pointer(spark: SparkSession, base: str, version: str) -> None:
    """Switch to ``version``: the pointer is written aside and renamed over the old one in one step."""
    store, aside, jvm = hadoop_path(spark, f"{base}/.{POINTER}-{uuid.uuid4().hex}")
    stream = store.create(aside, False)
    try:
        stream.write(bytearray(version, "utf-8"))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    target = store.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{base}/{POINTER}"))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(store.makeQualified(aside), target, options)


def current_version(spark: SparkSession, base: str) -> str | None:
    if not path_exists(spark, f"{base}/{POINTER}"):
        return None
    return spark.read.text(f"{base}/{POINTER}").first().value


def read_current(spark: SparkSession, base: str, schema: StructType | None = None) -> DataFrame:
    """The published table."""
    version = current_version(spark, base)
    if version is None:
        raise FileNotFoundError(f"nothing published at {base}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{base}/{version}/table")


def plain_numbers(df: DataFrame) -> DataFrame:
    """Decimals as text without an exponent: at least one place, no zeros after it."""
    shown = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if field.dataType.typeName() == "decimal" and field.dataType.scale > 0:
            col = F.regexp_replace(col.cast("string"), r"(\.[0-9]+?)0+\z", "$1").alias(field.name)
        shown.append(col)
    return df.select(*shown)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV export in range-partitioned order: part files follow each other, each with a header.

    An empty result still writes the header.
    """
    shown = df
    if order:
        shown = df.orderBy(*order)
    elif df.isEmpty():
        shown = df.coalesce(1)
    shown = plain_numbers(shown)
    shown.write.mode("overwrite").csv(path, header=True, **CSV_FORMAT)


def publish(
    df: DataFrame,
    base: str,
    version: str,
    required: list[str] | None = None,
    order: list[str] | None = None,
    export: DataFrame | None = None,
) -> int:
    """Write ``df`` as ``version`` (parquet and CSV), check it, then switch to it. Returns its rows.

    ``required`` columns must hold no NULL. ``export`` is the CSV form when it differs. A version that
    was published is never written again: readers may still hold it.
    """
    spark = df.sparkSession
    home = f"{base.rstrip('/')}/{version}"
    if path_exists(spark, f"{home}/{PUBLISHED}"):
        raise FileExistsError(f"version {version} of {base} is already published")
    df.write.mode("overwrite").parquet(f"{home}/table")
    written = spark.read.schema(df.schema).parquet(f"{home}/table")
    bad = [F.count_if(F.col(c).isNull()).alias(c) for c in required or []]
    facts = written.agg(F.count("*").alias("__rows"), *bad).first()
    for column in required or []:
        if facts[column]:
            raise ValueError(f"{column} is NULL in {facts[column]} row(s); nothing published")
    if export is None or export is df:
        export = written
    write_csv(export, f"{home}/csv", order)
    store, mark, _ = hadoop_path(spark, f"{home}/{PUBLISHED}")
    store.create(mark, True).close()
    _write_pointer(spark, base.rstrip("/"), version)
    return facts["__rows"]


def current_csv(spark: SparkSession, base: str) -> str:
    """Folder of the published CSV."""
    return f"{base}/{current_version(spark, base)}/csv"


def write_checked_parquet(df: DataFrame, path: str) -> tuple[int, int]:
    """Replace ``path`` and read it back: (rows meant, rows read); a difference is an error.

    The row count meant is taken while writing, so the input is computed once.
    """
    spark = df.sparkSession
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    meant = seen.get["rows"]
    read = spark.read.schema(df.schema).parquet(path).count()
    if meant != read:
        raise ValueError(f"{path}: wrote {meant} rows, read back {read}")
    return meant, read


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Parquet at ``path``, or no rows while nothing was written there."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise
