"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE splits a hot shuffle partition of a join at run time. Forcing it accepts one more
# shuffle where a parent operator relied on the join's partitioning.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.ui.showConsoleProgress": "false",
}


TEXT_CODEC = "zstd"


def get_spark(app_name: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests, a laptop) may fall back to a temporary folder, which is
    then remembered in the session so all scratch data of one session lies together.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    remembered = spark.conf.get("spark.ledgerloom.localScratch", None)
    if not remembered:
        remembered = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.ledgerloom.localScratch", remembered)
    return remembered


def scratch_path(spark: SparkSession, label: str) -> str:
    """Unique path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors.

    Used where the same rows must be seen identically by several jobs, or where recomputing
    them would be dearer than one columnar write. ``compression`` is for whole rows of text, which
    :data:`TEXT_CODEC` makes a third smaller than the session's codec does.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
