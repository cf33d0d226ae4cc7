"""Lenient branch files: columns by header name, a bad file is reported and the rest go on."""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom.functions.text import na_to_null
from ledgerloom.operators.sets import stack
from ledgerloom.schemas import TRANSACTION_COLUMNS
from ledgerloom.sources.delimited import RECORD_LIMIT, csv_fields, number_lines, opens_quote, read_lines
from ledgerloom.sources.files import BRANCH_FILE_GLOB, find_branch_files, is_flat, only_files

# File error texts.
UNREADABLE = "Could not read file: "
MISSING_COLUMNS = "Missing required column(s): "

# File report columns.
FILE_REPORT = "file string, path string, header string, open_quotes boolean, error string"

# paths that Spark lists one by one before it starts a task for each of them
LISTED_SINGLY = 32


class Scans:
    """Scans of some of the branch files of a folder.

    Many files are named by their folder: Spark then lists one folder instead of running a task for each path.
    """

    def __init__(self, spark: SparkSession, folder: str, found: DataFrame, listed_singly: int = LISTED_SINGLY) -> None:
        self.spark, self.folder = spark, folder
        self.shown = {r.path: r.scan_name for r in found.select("path", "scan_name").collect()}
        self.by_folder = len(self.shown) > listed_singly and is_flat(spark, folder)
        self.listed_singly = listed_singly

    def read(self, paths: list[str], scan: Callable[[DataFrameReader, str | list[str]], DataFrame]) -> DataFrame:
        """``scan`` of these files."""
        if not self.by_folder or len(paths) <= self.listed_singly:
            return scan(self.spark.read, paths)
        whole = scan(self.spark.read.option("pathGlobFilter", BRANCH_FILE_GLOB), self.folder)
        wanted = set(paths)
        others = [name for path, name in self.shown.items() if path not in wanted]
        if not others:
            return whole
        if len(others) < len(paths):
            return whole.filter(~only_files(others))
        return whole.filter(only_files([self.shown[p] for p in paths]))


def _lines(scans: Scans, paths: list[str]) -> DataFrame:
    """Non-empty lines (file, place, line, value); a place is NULL beyond a file's first block."""
    value = F.col("value")
    first = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    line = F.when(F.startswith(value, F.lit("\ufeff")), F.substring(value, 2, RECORD_LIMIT)).otherwise(value)
    lines = scans.read(paths, lambda reader, at: reader.text(at))
    return lines.select(F.col("_metadata.file_name").alias("file"), first.alias("place"), line.alias("line"), "value").filter("line <> ''")


def _probe(scans: Scans, paths: list[str]) -> DataFrame:
    """Per file: first non-empty line, longest row, longest line and whether a quoted value spans lines.

    The least of texts would sort all lines. Lines that look like a header are few, so they are a key of the
    grouping beside the file; ``place`` is the first line's, and ``header`` NULL when that looks like none.
    """
    value = F.col("value")
    titled = F.when(F.col("place").isNotNull() & F.contains("line", F.lit(TRANSACTION_COLUMNS[0])), F.col("line"))
    return (
        _lines(scans, paths)
        .groupBy("file", titled.alias("title"))
        .agg(
            F.min("place").alias("place"),
            F.max(F.size(csv_fields(value))).alias("width"),
            F.max(F.char_length(value)).alias("chars"),
            F.bool_or(opens_quote(value)).alias("odd"),
        )
        .groupBy("file")
        .agg(
            F.min_by("title", "place").alias("header"),
            F.min("place").alias("place"),
            F.max("width").alias("width"),
            F.max("chars").alias("chars"),
            F.bool_or("odd").alias("open_quotes"),
        )
    )


def _first_lines(scans: Scans, paths: list[str]) -> dict[str, str]:
    """First non-empty line of each of the files."""
    if not paths:
        return {}
    return dict(_lines(scans, paths).groupBy("file").agg(F.min_by("line", "place")).collect())


def _joined_widths(spark: SparkSession, paths: list[str]) -> dict[str, tuple[int, bool]]:
    """Longest record and whether one is oversize, of files whose quoted values span lines; one short row per file."""
    if not paths:
        return {}
    width = F.max(F.size(csv_fields(F.col("line")))).alias("width")
    found = read_lines(spark, paths, None).groupBy("source_filename").agg(width, F.bool_or("oversize").alias("oversize"))
    return {r.source_filename: (r.width, r.oversize) for r in found.collect()}


def _joined_rows(spark: SparkSession, paths: list[str], names: list[str]) -> DataFrame:
    """Rows of files whose quoted values span lines, by position; the files are read split."""
    records = number_lines(read_lines(spark, paths, None)).filter(F.col("record_number").isNotNull())
    fields = records.withColumn("fields", csv_fields(F.col("line")))
    return fields.select(
        *[na_to_null(F.get("fields", i)).alias(n) for i, n in enumerate(names)], F.col("source_filename").alias("source_file")
    )


def _names(header: str) -> list[str]:
    """Header names; a repeated name gets a running suffix."""
    seen: dict[str, int] = defaultdict(int)
    names = []
    for name in next(csv.reader([header])):
        names.append(f"{name}.{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return names


def file_report(spark: SparkSession, folder: str) -> DataFrame:
    """One row per branch file: file, path, header, open_quotes, error (NULL when readable).

    Values may be of any length; only a record beyond ``RECORD_LIMIT`` is a fault, on one line or on several.

    Faults are decided on the driver from one short row per file, as the file list itself is.
    """
    found = find_branch_files(spark, folder)
    return _report(spark, Scans(spark, folder, found), found)


def _report(spark: SparkSession, scans: Scans, found: DataFrame) -> DataFrame:
    probed = found.join(_probe(scans, list(scans.shown)), F.col("filename") == F.col("file"), "left")
    listed = probed.select("filename", "path", "header", "place", "width", "chars", "open_quotes").collect()
    untitled = _first_lines(scans, [r.path for r in listed if r.header is None and r.place is not None])
    joined = _joined_widths(spark, [r.path for r in listed if r.open_quotes])
    rows = []
    for r in listed:
        error, header = None, untitled.get(r.filename, r.header)
        if header is None:
            error = UNREADABLE + "No columns to parse from file"
        else:
            names = _names(header)
            absent = [c for c in TRANSACTION_COLUMNS if c not in names]
            width, oversize = joined.get(r.filename, (r.width, r.chars > RECORD_LIMIT))
            if oversize:
                error = f"{UNREADABLE}record larger than record limit ({RECORD_LIMIT})"
            elif width > len(names):
                error = f"{UNREADABLE}Expected {len(names)} fields, saw {width}"
            elif absent:
                error = MISSING_COLUMNS + ", ".join(absent)
        rows.append((r.filename, r.path, header, r.open_quotes, error))
    return spark.createDataFrame(sorted(rows), FILE_REPORT)


def read_branch_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows of all readable files, file report). No readable file at all is an error.

    Files with the same header are one scan, and every file is read split. Columns beyond the six are kept and NULL for files that lack them.
    """
    found = find_branch_files(spark, folder)
    scans = Scans(spark, folder, found)
    report = _report(spark, scans, found)
    groups: dict[tuple[str, bool], list[str]] = defaultdict(list)
    for r in report.filter(F.col("error").isNull()).collect():
        groups[(r.header, bool(r.open_quotes))].append(r.path)
    if not groups:
        raise ValueError("No branch files could be read successfully. See file_errors for details.")
    frames = []
    for (header, multi_line), paths in sorted(groups.items()):
        names = _names(header)
        if multi_line:
            frames.append(_joined_rows(spark, paths, names))
            continue
        schema = StructType([StructField(n, StringType()) for n in names])
        scan = scans.read(paths, lambda reader, at: reader.csv(at, schema=schema, header=True, quote='"', escape='"', enforceSchema=True))
        frames.append(
            scan.select(
                *[na_to_null(F.col(f"`{n}`")).alias(n) for n in names],
                F.col("_metadata.file_name").alias("source_file"),
            )
        )
    return stack(frames), report
