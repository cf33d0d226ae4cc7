"""Data-quality counters, gates, declarative tests, constraints and reconciliation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import CURRENCY, TRANSACTION_TYPES
from ledgerloom.functions.text import join_reasons, reason_list
from ledgerloom.operators.aggregates import duplicate_groups
from ledgerloom.operators.joins import unmatched_rows
from ledgerloom.operators.sets import stack
from ledgerloom.session import materialize

# Names and order of the eight checks.
NULL_IDS = "Null transaction IDs"
NULL_ACCOUNTS = "Null account IDs (transactions)"
NULL_AMOUNTS = "Null amounts"
DUPLICATE_IDS = "Duplicate transaction IDs"
ORPHAN_TRANSACTIONS = "Transactions referencing nonexistent accounts"
ORPHAN_CUSTOMERS = "Accounts referencing nonexistent customers"
ORPHAN_BRANCHES = "Accounts referencing nonexistent branches"
BAD_AMOUNTS = "Non-positive amounts"
CHECK_ORDER = [
    NULL_IDS, NULL_ACCOUNTS, NULL_AMOUNTS, DUPLICATE_IDS,
    ORPHAN_TRANSACTIONS, ORPHAN_CUSTOMERS, ORPHAN_BRANCHES, BAD_AMOUNTS,
]


class DataQualityError(Exception):
    """A gate found failing checks."""


def run_checks(tx: DataFrame, accounts: DataFrame, customers: DataFrame, branches: DataFrame) -> DataFrame:
    """The eight checks as (check, bad).

    One pass over transactions per account answers five of them: the null and sign counters
    ride along with the per-account counts that the orphan check needs anyway.
    """
    per_account = tx.groupBy("account_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("transaction_id").isNull()).alias("null_ids"),
        F.count_if(F.col("amount").isNull()).alias("null_amounts"),
        F.count_if(F.col("amount") <= 0).alias("bad_amounts"),
    )
    known = accounts.select(F.col("account_id").alias("known_account")).distinct()
    placed = per_account.join(known, F.col("account_id") == F.col("known_account"), "left")
    missing, orphan = F.col("account_id").isNull(), F.col("known_account").isNull()

    def total(value):
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    first_five = placed.agg(
        total("null_ids").alias(NULL_IDS),
        total(F.when(missing, F.col("n"))).alias(NULL_ACCOUNTS),
        total("null_amounts").alias(NULL_AMOUNTS),
        total(F.when(~missing & orphan, F.col("n"))).alias(ORPHAN_TRANSACTIONS),
        total("bad_amounts").alias(BAD_AMOUNTS),
    )
    named = [NULL_IDS, NULL_ACCOUNTS, NULL_AMOUNTS, ORPHAN_TRANSACTIONS, BAD_AMOUNTS]
    long_form = first_five.unpivot([], [F.col(f"`{n}`") for n in named], "check", "bad")
    others = [
        (DUPLICATE_IDS, duplicate_groups(tx, "transaction_id")),
        (ORPHAN_CUSTOMERS, unmatched_rows(accounts, customers, "customer_id")),
        (ORPHAN_BRANCHES, unmatched_rows(accounts, branches, "branch_id")),
    ]
    return stack([long_form, *[df.select(F.lit(name).alias("check"), "bad") for name, df in others]])


def with_status(checks: DataFrame) -> DataFrame:
    return checks.withColumn("status", F.when(F.col("bad") == 0, "PASS").otherwise("FAIL"))


def gate(checks: DataFrame) -> None:
    """Raise when any check failed, naming each with its count. Reads one row per check."""
    failed = {r["check"]: r["bad"] for r in checks.filter(F.col("bad") > 0).collect()}
    if failed:
        order = {name: i for i, name in enumerate(CHECK_ORDER)}
        names = sorted(failed, key=lambda name: (order.get(name, len(order)), name))
        details = "; ".join(f"{name}: {failed[name]}" for name in names)
        raise DataQualityError(f"{len(failed)} data quality check(s) failed - {details}")


# --- declarative tests: each returns the failing rows, so "empty" means "passed" ---


def not_unique(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("failing_value"))
        .agg(F.count("*").alias("failing_rows"))
        .filter(F.col("failing_rows") > 1)
    )


def nulls(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNull())
        .groupBy(F.col(column).cast("string").alias("failing_value"))
        .agg(F.count("*").alias("failing_rows"))
    )


def without_parent(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Child values that the parent lacks, counted per value before the join."""
    per_value = child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("failing_rows"))
    keys = parent.select(F.col(field).alias(column))
    return per_value.join(keys, column, "left_anti").select(
        F.col(column).cast("string").alias("failing_value"), "failing_rows"
    )


def not_accepted(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return (
        df.filter(~F.col(column).isin(values))
        .groupBy(F.col(column).cast("string").alias("failing_value"))
        .agg(F.count("*").alias("failing_rows"))
    )


def is_negative_amount(amount: Column) -> Column:
    """The text reads as a number below zero; unreadable text does not."""
    return amount.try_cast("decimal(18,2)") < 0


def negative_amounts(raw: DataFrame) -> DataFrame:
    """Raw rows whose amount reads as a number below zero; unreadable text is not reported."""
    return raw.filter(is_negative_amount(F.col("amount"))).select("transaction_id", "amount")


@dataclass(frozen=True)
class ColumnTest:
    """One declarative test of a column: which of its values to look at, and when a value has failed.

    ``looked_at`` picks rows. Of the values found there, all fail, or with ``once`` those that occur more than once,
    or with ``parent`` those that the only column of ``parent`` lacks; child and parent are compared as text.
    """

    column: str
    looked_at: Column
    once: bool = False
    parent: DataFrame | None = None


def unique(column: str) -> ColumnTest:
    return ColumnTest(column, F.col(column).isNotNull(), once=True)


def not_null(column: str) -> ColumnTest:
    return ColumnTest(column, F.col(column).isNull())


def has_parent(column: str, parent: DataFrame, field: str) -> ColumnTest:
    return ColumnTest(column, F.col(column).isNotNull(), parent=parent.select(field))


def accepted(column: str, values: list[str]) -> ColumnTest:
    return ColumnTest(column, ~F.col(column).isin(values))


def never(column: str, condition: Column) -> ColumnTest:
    """A row fails where the condition holds; an unknown condition does not fail."""
    return ColumnTest(column, condition)


def failing_values(df: DataFrame, tests: dict[str, ColumnTest]) -> DataFrame:
    """(test_name, failing_value, failing_rows) of all tests of one table from one scan and one grouping.

    A row yields one (test, value) pair for each test that looks at it, and equal pairs are counted on the map side:
    a hot or a missing value is one row per task. What is left after the counting meets the parents.
    """
    pairs = [
        F.when(t.looked_at, F.struct(F.lit(i).alias("test"), F.col(t.column).cast("string").alias("failing_value")))
        for i, t in enumerate(tests.values())
    ]
    counted = (
        df.select(F.explode(F.array(*pairs)).alias("pair"))
        .filter(F.col("pair").isNotNull())
        .groupBy("pair.test", "pair.failing_value")
        .agg(F.count("*").alias("failing_rows"))
    )
    once = [i for i, t in enumerate(tests.values()) if t.once]
    parents = [
        t.parent.toDF("value").select(F.lit(i).alias("test"), F.col("value").cast("string").alias("failing_value"))
        for i, t in enumerate(tests.values())
        if t.parent is not None
    ]
    failing = counted.filter(~F.col("test").isin(once) | (F.col("failing_rows") > 1)) if once else counted
    if parents:
        failing = failing.join(stack(parents), ["test", "failing_value"], "left_anti")
    names = F.array(*[F.lit(name) for name in tests])
    return failing.select(F.get(names, F.col("test")).alias("test_name"), "failing_value", "failing_rows")


def run_tests(tables: list[tuple[DataFrame, dict[str, ColumnTest]]]) -> DataFrame:
    """(test_name, failing_values, failing_rows, passed), one row per test, the passed ones included.

    Each table is read once for all its tests, and once more where it is another one's parent.
    """
    names = [name for _, tests in tables for name in tests]
    figures = []
    for name in names:
        mine = F.col("test_name") == name
        rows = F.coalesce(F.sum(F.when(mine, F.col("failing_rows"))), F.lit(0)).cast("long")
        figures.append(
            F.struct(F.lit(name).alias("test_name"), F.count_if(mine).alias("failing_values"), rows.alias("failing_rows"))
        )
    failing = stack([failing_values(df, tests) for df, tests in tables])
    return (
        failing.agg(F.array(*figures).alias("figures"))
        .select(F.inline("figures"))
        .withColumn("passed", F.col("failing_values") == 0)
    )


# --- constraints ---


def check_constraints(
    df: DataFrame,
    table: str,
    primary_key: str,
    not_null: list[str],
    parents: dict[str, DataFrame] | None = None,
    transaction_checks: bool = False,
) -> DataFrame:
    """Add ``violations``: the constraints a row breaks (primary key, NOT NULL, foreign key, CHECK).

    With a repeated primary key every copy is flagged: a table has no arrival order.
    """
    flagged = df
    repeated = df.groupBy(primary_key).agg(F.count("*").alias("__copies")).filter(F.col("__copies") > 1)
    flagged = flagged.join(repeated, primary_key, "left")
    rules = [(f"{table} primary key {primary_key}", F.col("__copies").isNotNull() | F.col(primary_key).isNull())]
    rules += [(f"{table} not null {c}", F.col(c).isNull()) for c in not_null if c != primary_key]
    extra = ["__copies"]
    for key, parent in (parents or {}).items():
        name = f"__parent_{key}"
        keys = parent.select(F.col(key).alias(name)).distinct()
        flagged = flagged.join(keys, F.col(key) == F.col(name), "left")
        rules.append((f"{table} foreign key {key}", F.col(key).isNotNull() & F.col(name).isNull()))
        extra.append(name)
    if transaction_checks:
        rules += [
            (f"{table} check transaction_type", ~F.col("transaction_type").isin(TRANSACTION_TYPES)),
            (f"{table} check amount", F.col("amount") <= 0),
            (f"{table} check currency", F.col("currency") != CURRENCY),
        ]
    return flagged.withColumn("violations", reason_list(rules)).select(*df.columns, "violations")


def split_by_constraints(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with ``violations`` as text)."""
    fine = F.size("violations") == 0
    return (
        checked.filter(fine).drop("violations"),
        checked.filter(~fine).withColumn("violations", join_reasons(F.col("violations"))),
    )


# --- metric table ---

# Metric names.
M_DISCOVERED = "files_discovered"
M_READ = "files_successfully_read"
M_REJECTED = "files_rejected_or_skipped"
M_TOTAL = "total_input_records"
M_VALID = "valid_records"
M_INVALID = "invalid_records"
M_RATE = "rejection_rate_percent"
M_DUPLICATE = "duplicate_transaction_count"
P_FILE = "records_from_"
P_REASON = "invalid_reason: "
P_ERROR = "file_error: "


def metric_table(validated: DataFrame, files: DataFrame, duplicate_reason: str) -> DataFrame:
    """Delivery metrics as (metric, value), both text.

    ``validated`` has source_file, reasons, is_valid; ``files`` has file, error (NULL when read).
    A file without rows is still listed, with 0. The rows are folded once, to one row per file and set
    of reasons; every figure is a sum over that small table.
    """
    folded = materialize(validated.groupBy("source_file", "is_valid", "reasons").agg(F.count("*").alias("rows")), "judged-counts")
    repeated = F.when(F.array_contains("reasons", duplicate_reason), F.col("rows")).otherwise(0)
    per_file = folded.groupBy("source_file").agg(
        F.sum("rows").alias("n"),
        F.sum(F.when(F.col("is_valid"), F.col("rows")).otherwise(0)).alias("valid"),
        F.sum(repeated).alias("repeated"),
    )
    by_reason = (
        folded.filter(~F.col("is_valid")).select(F.explode("reasons").alias("reason"), "rows").groupBy("reason").agg(F.sum("rows").alias("rows"))
    )
    listed = files.join(per_file, F.col("file") == F.col("source_file"), "left").select(
        "file",
        "error",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("valid", F.lit(0)).alias("valid"),
        F.coalesce("repeated", F.lit(0)).alias("repeated"),
    )
    read = F.col("error").isNull()
    totals = listed.agg(
        F.count("*").alias("files"),
        F.count_if(read).alias("read"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"),
        F.coalesce(F.sum("valid"), F.lit(0)).cast("long").alias("valid"),
        F.coalesce(F.sum("repeated"), F.lit(0)).cast("long").alias("repeated"),
    )
    invalid = F.col("n") - F.col("valid")
    rate = F.when(F.col("n") > 0, F.round(invalid.cast("decimal(20,0)") * 100 / F.col("n"), 2)).otherwise(0)
    headline = totals.select(
        F.col("files").cast("string").alias(M_DISCOVERED),
        F.col("read").cast("string").alias(M_READ),
        (F.col("files") - F.col("read")).cast("string").alias(M_REJECTED),
        F.col("n").cast("string").alias(M_TOTAL),
        F.col("valid").cast("string").alias(M_VALID),
        invalid.cast("string").alias(M_INVALID),
        rate.cast("double").cast("string").alias(M_RATE),
        F.col("repeated").cast("string").alias(M_DUPLICATE),
    )
    names = [M_DISCOVERED, M_READ, M_REJECTED, M_TOTAL, M_VALID, M_INVALID, M_RATE, M_DUPLICATE]
    return stack(
        [
            headline.unpivot([], names, "metric", "value"),
            listed.filter(read).select(
                F.concat(F.lit(P_FILE), "file").alias("metric"), F.col("n").cast("string").alias("value")
            ),
            by_reason.select(
                F.concat(F.lit(P_REASON), "reason").alias("metric"), F.col("rows").cast("string").alias("value")
            ),
            files.filter(~read).select(
                F.concat(F.lit(P_ERROR), "file").alias("metric"), F.col("error").alias("value")
            ),
        ]
    )


# --- reconciliation ---


def reconcile_files(source_rows: DataFrame, checked: DataFrame) -> DataFrame:
    """Per file: rows delivered, in bronze, accepted, rejected, and whether they agree.

    ``source_rows`` has source_filename, source_rows; ``checked`` has source_filename, is_valid.
    """
    counted = checked.groupBy("source_filename").agg(
        F.count("*").alias("bronze_rows"),
        F.count_if("is_valid").alias("accepted_rows"),
        F.count_if(~F.col("is_valid")).alias("rejected_rows"),
    )
    joined = source_rows.join(counted, "source_filename", "left").fillna(
        0, ["bronze_rows", "accepted_rows", "rejected_rows"]
    )
    agrees = (F.col("bronze_rows") == F.col("source_rows")) & (
        F.col("accepted_rows") + F.col("rejected_rows") == F.col("source_rows")
    )
    return joined.withColumn("reconciled", agrees)


def assert_reconciled(files: DataFrame) -> None:
    """Raise for the first file that does not add up."""
    bad = files.filter(~F.col("reconciled")).orderBy("source_filename").limit(1).collect()
    for r in bad:
        raise ValueError(
            f"{r.source_filename}: reconciliation failed - source_rows={r.source_rows}, "
            f"bronze={r.bronze_rows}, accepted={r.accepted_rows}, rejected={r.rejected_rows}"
        )


def assert_grain(df: DataFrame, key: str) -> None:
    """One row per key, and at least one row."""
    row = df.agg(F.count("*").alias("n"), F.countDistinct(key).alias("k")).first()
    if row.n != row.k:
        raise ValueError(f"grain check failed: rows={row.n}, distinct {key}={row.k}")
    if row.n == 0:
        raise ValueError("grain check failed: no rows")


def join_completeness(rows: DataFrame, summary: DataFrame, count_column: str = "transaction_count") -> DataFrame:
    """Do the summary's counts add up to the input rows? (input_rows, summary_rows, complete)"""
    added = summary.agg(F.coalesce(F.sum(count_column), F.lit(0)).cast("long").alias("s")).scalar()
    return (
        rows.agg(F.count("*").alias("input_rows"))
        .withColumn("summary_rows", added)
        .withColumn("complete", F.col("input_rows") == F.col("summary_rows"))
    )


def totals_agree(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """Two tables' totals side by side as one-value subqueries: (left_total, right_total, agree)."""
    one = left.agg(F.sum(left_column).alias("left_total"))
    two = right.agg(F.sum(right_column).alias("t")).scalar()
    return one.withColumn("right_total", two).withColumn(
        "agree", F.col("left_total").eqNullSafe(F.col("right_total"))
    )
