"""File manifests: what lies in a folder, what it is called and what its content hashes to."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.dates import compact_date
from ledgerloom.session import materialize

# File name patterns and the reasons for unrecognized names.
BRANCH_FILE_GLOB = "BR*_*_TRANSACTION.csv"
BRANCH_FILE_REGEX = r"^(BR[0-9]+)_([0-9]{8})_TRANSACTION\.csv\z"
DAILY_FILE_GLOB = "transactions_*.csv"
NAME_MISMATCH = "filename does not match BR<digits>_<YYYYMMDD>_TRANSACTION.csv"
NAME_BAD_DATE = "filename date is not a real calendar date"

# a binary column holds 2 GiB at most; larger files are hashed line by line, through the same file system
WHOLE_FILE_LIMIT = 1 << 30
BYTE_ORDER_MARK = b"\xef\xbb\xbf"

# a name without signs that scans escape
PLAIN_NAME = re.compile(r"[A-Za-z0-9._-]+")

# Columns of a listing, and of what is remembered of a file.
LISTING = "path string, filename string, length bigint, modified bigint, scan_name string"
HASHED_COLUMNS = ["path", "length", "modified", "sha256"]
HASHED = "path string, length bigint, modified bigint, sha256 string"


def path_texts(spark: SparkSession, statuses) -> list[str]:
    """Paths of what a file system listed."""
    return [p.toString() for p in spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(statuses)]


def is_flat(spark: SparkSession, folder: str) -> bool:
    """Has the folder no folder inside? Then a scan of it sees the files directly in it and nothing else."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getDirectoryCount() == 1


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, filename, length, modified, scan_name) of the files directly in ``folder``; contents are not read.

    ``modified`` is the time of the last change in milliseconds, ``scan_name`` the name as scans show it, with
    signs escaped.

    The driver lists the folder, as Spark does before any scan. Unlike a scan the listing also
    has empty files and names that start with '_' or '.'.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(target):
        raise FileNotFoundError(folder)
    found, statuses = [], store.listStatus(target)
    # a question to the JVM costs more than all else here, so a file is asked what its path does not tell
    for path, status in zip(path_texts(spark, statuses), statuses, strict=True):
        name = path.rsplit("/", 1)[-1]
        if fnmatchcase(name, glob) and status.isFile():
            shown = name if PLAIN_NAME.fullmatch(name) else status.getPath().toUri().getRawPath().rsplit("/", 1)[-1]
            found.append((path, name, status.getLen(), status.getModificationTime(), shown))
    return spark.createDataFrame(sorted(found), LISTING)


def find_branch_files(spark: SparkSession, folder: str) -> DataFrame:
    """Branch files of a folder; none at all is an error."""
    found = list_files(spark, folder, BRANCH_FILE_GLOB)
    if found.isEmpty():
        raise FileNotFoundError(
            f"No branch transaction files found in '{folder}'. "
            f"Expected files matching pattern {BRANCH_FILE_GLOB}"
        )
    return found


def branch_of(filename: Column) -> Column:
    return F.nullif(F.regexp_extract(filename, BRANCH_FILE_REGEX, 1), F.lit(""))


def classify_names(files: DataFrame) -> DataFrame:
    """Add branch_id, file_date and, for unrecognized names, ``reason``."""
    matches = F.col("filename").rlike(BRANCH_FILE_REGEX)
    day = compact_date(F.regexp_extract("filename", BRANCH_FILE_REGEX, 2))
    return files.withColumns(
        {
            "file_date": day,
            "branch_id": F.when(day.isNotNull(), branch_of(F.col("filename"))),
            "reason": F.when(~matches, NAME_MISMATCH).when(day.isNull(), NAME_BAD_DATE),
        }
    )


def _line_hashes(batches: Iterator) -> Iterator:
    """SHA-256 of files whose lines come in order, file after file.

    Lines come without their line feeds, and the reader drops a byte order mark: how many bytes are missing in
    the end tells whether there was a mark (3) and whether the last line had a line feed (1).
    """
    import pyarrow as pa

    path, length, count, states = None, 0, 0, []

    def finished() -> pa.RecordBatch:
        missing = length - count
        marked, plain = states
        digest = (marked if missing >= len(BYTE_ORDER_MARK) else plain).copy()
        if missing % len(BYTE_ORDER_MARK) == 1:
            digest.update(b"\n")
        known = digest.hexdigest() if missing in (0, 1, 3, 4) else None
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([known], pa.string())], names=["path", "sha256"])

    for batch in batches:
        for own, size, line in zip(*(batch.column(c) for c in ("path", "length", "line")), strict=True):
            if own.as_py() != path:
                if path is not None:
                    yield finished()
                path, length, count = own.as_py(), size.as_py(), -1
                states = [hashlib.sha256(BYTE_ORDER_MARK), hashlib.sha256()]
            data = line.as_buffer()
            for state in states:
                if count >= 0:
                    state.update(b"\n")
                state.update(data)
            count += 1 + len(data)
    if path is not None:
        yield finished()


def only_files(files: list[str]) -> Column:
    """Files of a scan by name; Spark drops the others before it opens any."""
    return F.col("_metadata.file_name").isin(files)


def _hashed_by_line(spark: SparkSession, folder: str, large: DataFrame) -> DataFrame:
    """(path, sha256) of files of any size: read split by Spark, brought in order by a shuffle, hashed as a stream."""
    wanted = [r.scan_name for r in large.select("scan_name").collect()]
    lines = spark.read.text(folder, lineSep="\n").filter(only_files(wanted)).select(
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").cast("binary").alias("line"),
    )
    named = lines.join(F.broadcast(large.select(F.col("scan_name").alias("name"), "path", "length")), "name")
    ordered = named.repartition("path").sortWithinPartitions("path", "block", "seq").select("path", "length", "line")
    return ordered.mapInArrow(_line_hashes, "path string, sha256 string")


def with_sha256(
    spark: SparkSession, folder: str, whole_file_limit: int = WHOLE_FILE_LIMIT, known: DataFrame | None = None
) -> DataFrame:
    """(path, filename, length, modified, sha256) of the files directly in ``folder``.

    Files that ``known`` (path, length, modified, sha256) holds with the same length and time are not opened. Of
    the others the content of a file up to ``whole_file_limit`` is hashed in one piece; the length filter reaches
    the scan, so a larger one is never loaded whole but hashed line by line. Both read through Spark's file
    systems. A hidden file keeps a NULL hash, and so does a large packed one, whose lines are not its bytes.
    """
    listing = list_files(spark, folder)
    whole_file_limit = max(whole_file_limit, len(BYTE_ORDER_MARK))  # a mark alone gives no line
    place = ["path", "length", "modified"]
    if known is not None:
        # the driver holds the listing anyway; what is remembered of these files is no longer than it
        kept = materialize(listing.join(known.filter("sha256 IS NOT NULL").select(*HASHED_COLUMNS), place).dropDuplicates(place), "known-files")
        new = materialize(listing.join(kept, place, "left_anti"), "new-files")
    else:
        kept, new = None, listing
    found = new.filter(F.col("length") == 0).select("path", F.sha2(F.lit(""), 256).alias("sha256"))
    short = new.filter((F.col("length") > 0) & (F.col("length") <= whole_file_limit))
    small = [r.scan_name for r in short.select("scan_name").collect()]
    if small:
        whole = spark.read.format("binaryFile").load(folder).filter(only_files(small) & (F.col("length") <= whole_file_limit))
        content = whole.select(F.col("_metadata.file_name").alias("scan_name"), F.sha2("content", 256).alias("sha256"))
        found = found.unionByName(content.join(F.broadcast(short.select("scan_name", "path")), "scan_name").select("path", "sha256"))
    large = new.filter(F.col("length") > whole_file_limit)
    if not large.isEmpty():
        found = found.unionByName(_hashed_by_line(spark, folder, large))
    columns = ["path", "filename", "length", "modified", "sha256"]
    hashed = new.join(found, "path", "left").select(*columns)
    return hashed if kept is None else hashed.unionByName(kept.select(*columns))


def discover(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """Manifest of a landing folder: (path, filename, branch_id, file_date, sha256, reason, length, modified).

    Files that ``known`` holds unchanged are not opened, see :func:`with_sha256`.
    """
    return classify_names(with_sha256(spark, folder, known=known)).select(
        "path", "filename", "branch_id", "file_date", "sha256", "reason", "length", "modified"
    )
