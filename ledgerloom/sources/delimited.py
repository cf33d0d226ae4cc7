"""Delimited text files with per-file meaning: header checks, field counts, row numbers.

Lines are read as text, so a huge file is split over many tasks. Row numbers come from counts
per file block plus a line's place inside its block: no task ever sees a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import is_missing, strip
from ledgerloom.schemas import TRANSACTION_COLUMNS
from ledgerloom.session import TEXT_CODEC, materialize

# Fixed value: longest value of strict, reference and daily files, in characters; a longer one is a fault of its file
FIELD_LIMIT = 131_072
# longest record of any file, on one line or on several: a row of a table holds it whole
RECORD_LIMIT = 1 << 28

# possessive loops: the regex engine recurses on the others, once for every character
_QUOTED_FIELDS = r',(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+)'
_QUOTED_FIELD = r'^"([^"]*+(?:""[^"]*+)*+)"([^,]*+)\z'
_CLOSED_QUOTES = r'(^|,)"[^"]*+(?:""[^"]*+)*+"'


def csv_fields(line: Column) -> Column:
    """Fields of one line as an array; quotes may hide commas and doubled quotes."""

    def unquote(part: Column) -> Column:
        text = F.substring(part, F.lit(2), F.length(part))
        bare = F.replace(F.regexp_replace(text, _QUOTED_FIELD, "$1$2"), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(text, F.lit('"')), bare).otherwise(text)

    plain = F.split(line, ",", -1)
    parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_QUOTED_FIELDS), F.lit(0))
    return F.when(F.contains(line, F.lit('"')), F.transform(parts, unquote)).otherwise(plain)


def opens_quote(line: Column) -> Column:
    """Does a line that starts outside quotes end inside a quoted value?

    A quote opens a value only at its start; one inside an unquoted value is plain text.
    """
    left = F.regexp_replace(line, _CLOSED_QUOTES, "$1")
    return F.contains(line, F.lit('"')) & left.rlike(r'(^|,)"')


def join_quoted_lines(lines: DataFrame) -> DataFrame:
    """Lines with every quoted value that spans lines brought back into one line.

    Only files that have such values are touched. Whether a line starts inside quotes follows
    from the number of quotes before it: a running count inside each block plus the blocks' totals.
    A record longer than :data:`RECORD_LIMIT` - mostly a quote that is never closed - is one row with
    ``oversize`` set and no text, so no group can grow without bound.
    """
    files = materialize(lines.filter(opens_quote(F.col("line"))).select("source_filename").distinct(), "quoted")
    if files.isEmpty():
        return lines.withColumn("oversize", F.lit(False))
    place = ["source_filename", "block"]
    in_block = Window.partitionBy(*place).orderBy("seq")
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    upto = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks_before = Window.partitionBy("source_filename").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    counted = lines.join(files, "source_filename", "left_semi").withColumn("quotes", quotes)
    totals = counted.groupBy(*place).agg(F.sum("quotes").alias("q")).select(
        *place, F.coalesce(F.sum("q").over(blocks_before), F.lit(0)).alias("q_before")
    )
    counted = counted.join(totals, place).withColumn(
        "starts", (F.col("q_before") + F.coalesce(F.sum("quotes").over(earlier), F.lit(0))) % 2 == 0
    )
    start = F.when(F.col("starts"), F.struct("block", "seq"))
    carried = counted.groupBy(*place).agg(F.max(start).alias("s")).select(
        *place, F.last("s", ignorenulls=True).over(blocks_before).alias("carried")
    )
    records = (
        counted.withColumn("start", F.last(start, ignorenulls=True).over(upto))
        .join(carried, place)
        .withColumn("start", F.coalesce("start", "carried"))
    )
    # the size of a record is known before its lines meet
    size = records.groupBy("source_filename", "start").agg(F.sum(F.length("line") + 1).alias("chars"))
    large = size.filter(F.col("chars") > RECORD_LIMIT)
    parts = F.array_sort(F.collect_list(F.struct("block", "seq", "line")))
    joined = (
        records.join(large, ["source_filename", "start"], "left_anti")
        .groupBy("source_filename", "start")
        .agg(parts.alias("parts"))
        .select(
            "source_filename", "start.block", "start.seq",
            F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("line"),
            F.lit(False).alias("oversize"),
        )
    )
    unread = large.select("source_filename", "start.block", "start.seq", F.lit("").alias("line"), F.lit(True).alias("oversize"))
    whole = lines.join(files, "source_filename", "left_anti").withColumn("oversize", F.lit(False))
    return whole.unionByName(joined).unionByName(unread)


def read_lines(spark: SparkSession, paths: list[str], field_limit: int | None = FIELD_LIMIT) -> DataFrame:
    """Records of the files with their place: (source_filename, block, seq, line, oversize).

    Lines end at a line feed; a carriage return before it belongs to the line end only where the record
    ends, so a quoted value keeps its own line ends. ``oversize`` marks a record with a value beyond
    ``field_limit`` (None: there is none), or one beyond :data:`RECORD_LIMIT`, whether it lies on one line or on several.

    Written once to the shared folder: ``seq`` depends on how the scan was split, so every later
    step has to see the same numbers. Inside a (file, block) it grows with the line order.
    """
    raw = spark.read.text(paths, lineSep="\n").select(
        F.col("_metadata.file_name").alias("source_filename"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )
    records = join_quoted_lines(materialize(raw, "lines", TEXT_CODEC)).withColumn("line", F.regexp_replace("line", "\r\\z", ""))
    oversize = F.col("oversize") | (F.length("line") > RECORD_LIMIT)
    if field_limit is not None:
        wide = F.exists(csv_fields(F.col("line")), lambda v: F.char_length(v) > field_limit)
        oversize = oversize | ((F.length("line") > field_limit) & wide)
    return records.withColumn("oversize", oversize)


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_number`` (1 = first line of the file) and ``record_number``.

    ``record_number`` counts non-empty lines after the header line; it is NULL for the header
    and for empty lines.

    ``seq`` grows by one a line inside a block, so where no line is empty and no quoted value spans lines a
    number is the distance from the block's first line, and no line is moved. Only the other blocks are sorted.
    """
    place = ["source_filename", "block"]
    first_block, filled = F.col("block") == 0, F.col("oversize") | (F.col("line") != "")
    blocks = lines.groupBy(*place).agg(
        F.count("*").alias("lines"), F.count_if(filled).alias("filled"), F.min("seq").alias("first"),
        F.max("seq").alias("last"), F.min(F.when(filled, F.col("seq"))).alias("first_filled"),
    )
    # the header is no record, whether it is empty or not
    headed = F.when(first_block & (F.col("first_filled") == F.col("first")), 1).otherwise(0)
    dense = (F.col("last") - F.col("first") + 1 == F.col("lines")) & (F.col("filled") == F.col("lines"))
    # one row per block: the running window over a file's blocks stays small
    before = Window.partitionBy("source_filename").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(
        blocks.select(
            *place, "first", dense.alias("dense"),
            F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"),
            F.coalesce(F.sum(F.col("filled") - headed).over(before), F.lit(0)).alias("records_before"),
        ),
        "blocks",
    )
    placed = lines.join(blocks, place)

    def numbered(rows: DataFrame, n: Column, is_record: Column, r: Column) -> DataFrame:
        return rows.select(
            "source_filename",
            "line",
            (F.col("lines_before") + n).alias("line_number"),
            F.when(is_record, F.col("records_before") + r).alias("record_number"),
            "oversize",
        )

    n = F.col("seq") - F.col("first") + 1
    plain = numbered(placed.filter("dense"), n, ~(first_block & (n == 1)), n - F.when(first_block, 1).otherwise(0))
    if blocks.filter(~F.col("dense")).isEmpty():
        return plain
    in_block = Window.partitionBy(*place).orderBy("seq")
    upto = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sparse = placed.filter(~F.col("dense")).withColumn("n", F.row_number().over(in_block))
    sparse = sparse.withColumn("is_record", ~(first_block & (F.col("n") == 1)) & filled)
    sparse = sparse.withColumn("r", F.count_if("is_record").over(upto))
    sparse = numbered(sparse, F.col("n"), F.col("is_record"), F.col("r"))
    return plain.unionByName(materialize(sparse, "numbered", TEXT_CODEC))


def _readable(oversize: Column, value: Column) -> Column:
    """The value, or a failure of the query when it comes from an oversize record."""
    text = F.lit(f"field larger than field limit ({FIELD_LIMIT})")
    return F.when(oversize, F.raise_error(text).cast("string")).otherwise(value)


def _without_bom(line: Column) -> Column:
    return F.regexp_replace(line, "^\ufeff", "")


def headers(numbered: DataFrame) -> DataFrame:
    """(source_filename, header) with the stripped header fields; one row per non-empty file."""
    return numbered.filter(F.col("line_number") == 1).select(
        "source_filename", F.transform(csv_fields(_without_bom(F.col("line"))), strip).alias("header")
    )


# --- strict transaction files: any structural fault fails the file ---


def strict_rows(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows and per-file findings of transaction files with exactly the expected header.

    Rows: source_filename, source_row_number (1 = first data row, empty lines not counted) and
    the six values unchanged, empty text kept empty.
    Findings: source_filename, source_rows, error (NULL when the file is sound); a file without
    any line has no finding, see :func:`file_faults`.
    """
    numbered = number_lines(read_lines(spark, paths))
    width = len(TRANSACTION_COLUMNS)
    records = numbered.filter(F.col("record_number").isNotNull()).withColumn("fields", csv_fields(F.col("line")))
    rows = records.select(
        "source_filename",
        F.col("record_number").alias("source_row_number"),
        *[F.get("fields", i).alias(name) for i, name in enumerate(TRANSACTION_COLUMNS)],
    )
    size = F.size("fields")
    counted = records.groupBy("source_filename").agg(
        F.count("*").alias("source_rows"),
        F.min(F.when(F.col("oversize") | (size != width), F.struct("record_number", size.alias("fields"), "oversize"))).alias("bad"),
    )
    expected = F.array(*[F.lit(c) for c in TRANSACTION_COLUMNS])
    bad_header = F.concat(F.lit(": header does not match "), F.lit(",".join(TRANSACTION_COLUMNS)))
    bad_row = F.concat(
        F.lit(": data row "), F.col("bad.record_number"), F.lit(" has "), F.col("bad.fields"),
        F.lit(f" fields, expected {width}"),
    )
    too_long = F.lit(f": field larger than field limit ({FIELD_LIMIT})")
    fault = (
        F.when(F.col("header") != expected, bad_header)
        .when(F.col("bad.oversize"), too_long)
        .when(F.col("bad").isNotNull(), bad_row)
    )
    findings = (
        headers(numbered)
        .join(counted, "source_filename", "left")
        .select(
            "source_filename",
            F.coalesce("source_rows", F.lit(0)).alias("source_rows"),
            F.concat("source_filename", fault).alias("error"),
        )
    )
    return rows, findings


def file_faults(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings for every listed file (column ``filename``): one without lines is an empty file."""
    joined = files.join(findings, F.col("filename") == F.col("source_filename"), "left")
    empty = F.concat("filename", F.lit(": file is empty"))
    return joined.withColumn(
        "error", F.when(F.col("source_filename").isNull(), empty).otherwise(F.col("error"))
    ).withColumn("source_rows", F.coalesce("source_rows", F.lit(0))).drop("source_filename")


# --- reference files: header faults fail the file, row faults are kept with the row ---

EXTRA_VALUES = "_extra_values"


def read_reference_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Reference rows by header name, stripped: (source_filename, source_row_number, …, row_issues).

    Row numbers are physical lines, so the first data row is 2. All-blank rows are skipped. A row
    of the wrong length is kept: short ones padded with '', the surplus of long ones in
    ``_extra_values``, and ``row_issues`` names both lengths.
    """
    numbered = number_lines(read_lines(spark, [path]))
    name = path.rstrip("/").rsplit("/", 1)[-1]
    found = headers(numbered).limit(1).collect()
    if not found:
        raise ValueError(f"CSV is empty or has no header: {name}")
    header = found[0].header
    if any(not item for item in header):
        empty = header == [""]
        raise ValueError(
            f"CSV is empty or has no header: {name}" if empty else f"CSV contains an empty column name: {name}"
        )
    if len(header) != len(set(header)):
        raise ValueError(f"CSV contains duplicate column names: {name}")
    missing = sorted(set(required) - set(header))
    if missing:
        raise ValueError(f"{name} is missing required columns: {missing}")

    width = len(header)
    rows = numbered.filter(F.col("line_number") > 1).withColumn("fields", csv_fields(_readable(F.col("oversize"), F.col("line"))))
    rows = rows.filter(F.exists("fields", lambda v: ~is_missing(v)))
    size = F.size("fields")
    issue = F.concat(F.lit("row has "), size, F.lit(f" values; expected {width}"))
    values = [F.coalesce(strip(F.get("fields", i)), F.lit("")).alias(c) for i, c in enumerate(header)]
    return rows.select(
        "source_filename",
        F.col("line_number").alias("source_row_number"),
        *values,
        F.when(size > width, F.slice("fields", width + 1, F.greatest(size - width, F.lit(0)))).alias(EXTRA_VALUES),
        F.array_compact(F.array(F.when(size != width, issue))).alias("row_issues"),
    )


# --- daily files: by header name, in file and row order ---


def daily_rows(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows and per-file findings of daily files; a missing column is NULL.

    Rows: the six values by header name, source_file and row_no, of the files without a fault.
    Findings: source_filename, source_rows, error (NULL when sound); a value beyond the limit is the fault
    of its file, and the other files are read.
    """
    numbered = number_lines(read_lines(spark, paths))
    rows = numbered.filter(F.col("record_number").isNotNull())
    counted = rows.groupBy("source_filename").agg(
        F.count("*").alias("source_rows"), F.min(F.when(F.col("oversize"), F.col("record_number"))).alias("bad")
    )
    fault = F.concat(F.lit("data row "), F.col("bad"), F.lit(f": field larger than field limit ({FIELD_LIMIT})"))
    findings = materialize(
        headers(numbered)
        .join(counted, "source_filename", "left")
        .select("source_filename", "header", F.coalesce("source_rows", F.lit(0)).alias("source_rows"), fault.alias("error")),
        "daily-findings",
    )
    sound = findings.filter(F.col("error").isNull()).select("source_filename", "header")
    named = rows.join(sound, "source_filename").withColumn("fields", csv_fields(F.col("line")))

    def value(column: str) -> Column:
        place = F.array_position("header", column)
        return F.when(place > 0, F.try_element_at("fields", place.cast("int"))).alias(column)

    shaped = named.select(
        *[value(c) for c in TRANSACTION_COLUMNS],
        F.col("source_filename").alias("source_file"),
        F.col("record_number").alias("row_no"),
    )
    return shaped, findings.drop("header")


def read_daily_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of the sound ones of the daily files, see :func:`daily_rows`."""
    return daily_rows(spark, paths)[0]
