"""One row per customer, the exceptions behind it and the proof that both add up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import (
    empty_to_null,
    fingerprint,
    is_missing,
    join_reasons,
    json_record,
    normalize_reasons,
    reason_list,
    strip,
)
from ledgerloom.functions.money import sum_money
from ledgerloom.operators import rules as R
from ledgerloom.operators.joins import lookup, with_unknown_flag
from ledgerloom.operators.quality import assert_grain
from ledgerloom.operators.sets import stack
from ledgerloom.schemas import CUSTOMER_EXCEPTION_COLUMNS, TRANSACTION_COLUMNS
from ledgerloom.session import materialize
from ledgerloom.sinks.audit import utc_now, utc_text
from ledgerloom.sinks.lookup_table import ROWS_PER_FILE, look_up, write_for_lookup
from ledgerloom.sinks.publish import publish
from ledgerloom.sources.delimited import EXTRA_VALUES, read_reference_csv
from ledgerloom.streaming.dedup import first_accepted_wins, repeats_in_order

CUSTOMER_COLUMNS = ["customer_id", "customer_name", "customer_segment"]
ACCOUNT_COLUMNS = ["account_id", "customer_id", "branch_id", "account_type", "account_status"]
APPROVED_COLUMNS = ["customer_id", "account_count", "transaction_count", "total_transaction_amount"]

# Entity names.
CUSTOMER, ACCOUNT, TRANSACTION = "CUSTOMER", "ACCOUNT", "TRANSACTION"


def _checked(rows: DataFrame, key: str, rules, repeated: str) -> DataFrame:
    """Reference rows with ``reasons``: row issues, rules, then the repeat (first valid row wins).

    ``rules`` may end with rules that follow the repeat; they are given as a second list.
    """
    before, after = rules
    base = F.concat("row_issues", reason_list(before), reason_list(after) if after else F.array().cast("array<string>"))
    flagged = first_accepted_wins(
        rows.withColumn("__base", base), key, F.size("__base") == 0, ["source_row_number"], "__repeated"
    )
    repeat = [(repeated, F.col("__repeated"))]
    tail = reason_list([*repeat, *after])
    return flagged.withColumn("reasons", F.concat("row_issues", reason_list(before), tail)).drop(
        "__base", "__repeated"
    )


def check_customers(rows: DataFrame) -> DataFrame:
    return _checked(rows, "customer_id", (R.customer_rules(), []), R.CUSTOMER_REPEATED)


def check_accounts(rows: DataFrame, customers: DataFrame) -> DataFrame:
    """Account rows with reasons; the customer must be a valid one."""
    flagged = with_unknown_flag(rows, customers, "customer_id", "__stranger")
    orphan = (F.col("customer_id") != "") & F.col("__stranger")
    return _checked(
        flagged, "account_id", (R.account_rules(), [(R.CUSTOMER_UNKNOWN, orphan)]), R.ACCOUNT_REPEATED
    ).drop("__stranger")


def accepted(checked: DataFrame, columns: list[str]) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).select(*columns)


def exception_records(rows: DataFrame, entity: str, raw_columns: list[str]) -> DataFrame:
    """Rejected rows in the common ten-column shape; missing ids become NULL, ids are natural-key hashes."""
    ids = {
        name: empty_to_null(F.col(name)) if name in rows.columns else F.lit(None).cast("string")
        for name in ["customer_id", "account_id", "transaction_id"]
    }
    if EXTRA_VALUES in raw_columns:
        plain = [c for c in raw_columns if c != EXTRA_VALUES]
        raw = F.when(F.col(EXTRA_VALUES).isNull(), json_record(plain)).otherwise(json_record(raw_columns))
    else:
        raw = json_record(raw_columns)
    return (
        rows.filter(F.size("reasons") > 0)
        .withColumn("raw_record", raw)
        .select(
            fingerprint(
                F.lit(entity), F.col("source_filename"), F.col("source_row_number").cast("string"),
                F.col("raw_record"), join_reasons(F.col("reasons")),
            ).alias("exception_id"),
            F.lit(entity).alias("entity_type"),
            "source_filename",
            "source_row_number",
            *[value.alias(name) for name, value in ids.items()],
            "raw_record",
            join_reasons(F.col("reasons")).alias("rejection_reasons"),
            F.lit(utc_now()).alias("recorded_at"),
        )
    )


def import_exceptions(exceptions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Earlier rejected transactions, with the customer found through the account."""
    rows = exceptions.withColumn("reasons", normalize_reasons(F.col("rejection_reasons"), R.EARLIER_REJECTION))
    return exception_records(lookup(rows, accounts, "account_id", "customer_id"), TRANSACTION, TRANSACTION_COLUMNS)


def check_silver(silver: DataFrame, accounts: DataFrame) -> DataFrame:
    """Accepted transactions with the reasons why the customer summary cannot use them."""
    order = ["source_filename", "source_row_number"]
    rows = repeats_in_order(silver, "transaction_id", order, "__repeated")
    rows = lookup(rows, accounts, "account_id", "customer_id")
    no_id, no_account = is_missing(F.col("transaction_id")), is_missing(F.col("account_id"))
    return rows.withColumn(
        "reasons",
        reason_list(
            [
                (R.ID_MISSING, no_id),
                (R.SILVER_REPEATED, ~no_id & F.col("__repeated")),
                (R.ACCOUNT_MISSING, no_account),
                (R.ACCOUNT_UNMAPPED, ~no_account & F.col("customer_id").isNull()),
                (R.DATE_MISSING, is_missing(F.col("transaction_date").cast("string"))),
                (R.TYPE_MISSING, is_missing(F.col("transaction_type"))),
                (R.AMOUNT_MISSING, F.col("amount").isNull()),
                (R.CURRENCY_MISSING, is_missing(F.col("currency"))),
            ]
        ),
    ).drop("__repeated")


def customer_360(customers: DataFrame, accounts: DataFrame, silver: DataFrame) -> DataFrame:
    """Exactly one row per customer: account count, transaction count, total and last date.

    Both sides are aggregated before they meet the customer, so neither multiplies the other, and
    transactions fold per account first.
    """
    per_account = silver.groupBy("account_id").agg(
        F.count("transaction_id").alias("transaction_count"),
        sum_money(F.col("amount")).alias("gross_amount"),
        F.max("transaction_date").alias("last_transaction_date"),
    )
    owned = accounts.select("account_id", "customer_id").join(per_account, "account_id", "left")
    metrics = owned.groupBy("customer_id").agg(
        F.count("*").alias("account_count"),
        F.coalesce(F.sum("transaction_count"), F.lit(0)).alias("transaction_count"),
        F.sum("gross_amount").alias("total"),
        F.max("last_transaction_date").alias("last_transaction_date"),
    )
    return customers.join(metrics, "customer_id", "left").select(
        "customer_id",
        "customer_name",
        F.coalesce("account_count", F.lit(0)).cast("long").alias("account_count"),
        F.coalesce("transaction_count", F.lit(0)).cast("long").alias("transaction_count"),
        F.coalesce("total", F.lit(0)).cast("decimal(38,2)").alias("total_transaction_amount"),
        "last_transaction_date",
    )


def reconcile(gold: DataFrame, silver: DataFrame, accounts: DataFrame) -> DataFrame:
    """Gold against an independent join of silver and accounts, as one row."""
    per_account = silver.groupBy("account_id").agg(F.count("*").alias("n"), sum_money(F.col("amount")).alias("total"))
    mapped = per_account.join(accounts.select("account_id"), "account_id", "left_semi").agg(
        F.struct(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"),
            F.coalesce(F.sum("total"), F.lit(0)).cast("decimal(38,2)").alias("total"),
        ).alias("m")
    )
    everything = silver.agg(F.count("*").alias("n")).scalar()
    return (
        gold.agg(
            F.coalesce(F.sum("transaction_count"), F.lit(0)).cast("long").alias("gold_transaction_count"),
            F.coalesce(F.sum("total_transaction_amount"), F.lit(0)).cast("decimal(38,2)").alias("gold_total_amount"),
        )
        .withColumn("m", mapped.scalar())
        .select(
            F.col("m.n").alias("mapped_silver_transactions"),
            (everything - F.col("m.n")).alias("unmapped_silver_transactions"),
            F.col("m.total").alias("mapped_silver_amount"),
            "gold_transaction_count",
            "gold_total_amount",
        )
    )


def assert_gold_reconciled(figures) -> None:
    expected = (figures.mapped_silver_transactions, figures.mapped_silver_amount)
    actual = (figures.gold_transaction_count, figures.gold_total_amount)
    if expected != actual:
        raise ValueError(
            f"Customer 360 reconciliation failed: mapped Silver=({expected[0]}, {expected[1]:.2f}), "
            f"Gold=({actual[0]}, {actual[1]:.2f})"
        )


def exceptions_by_entity(exceptions: DataFrame) -> DataFrame:
    return exceptions.groupBy("entity_type").agg(F.count("*").alias("exception_count"))


def _wanted_id(customer_id: str) -> str:
    from urllib.parse import unquote

    wanted = unquote(customer_id).strip()
    if not wanted:
        raise ValueError("Customer ID is required")
    return wanted


def customer_lookup(gold: DataFrame, customer_id: str) -> DataFrame:
    """The approved columns of one customer, or no row. The id is only ever a value."""
    return gold.filter(F.col("customer_id") == F.lit(_wanted_id(customer_id))).select(*APPROVED_COLUMNS)


def store_for_lookup(gold: DataFrame, base: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write gold below ``base`` in the layout that ``stored_customer`` reads."""
    write_for_lookup(gold.select(*APPROVED_COLUMNS), base, "customer_id", rows_per_file)


def stored_customer(spark: SparkSession, base: str, customer_id: str) -> DataFrame:
    """``customer_lookup`` on stored gold: only the file that may hold the id is opened."""
    return look_up(spark, base, "customer_id", _wanted_id(customer_id))


def customer_lookups(gold: DataFrame, ids: DataFrame) -> DataFrame:
    """The approved columns for many ids at once; an unknown id has no row."""
    wanted = ids.select(strip(F.col("customer_id")).alias("customer_id")).distinct()
    return gold.join(wanted, "customer_id", "left_semi").select(*APPROVED_COLUMNS)


@dataclass(frozen=True)
class CustomerSummary:
    customers: DataFrame
    accounts: DataFrame
    gold: DataFrame
    exceptions: DataFrame
    summary: DataFrame


def build_customer_summary(
    spark: SparkSession, customer_csv: str, account_csv: str, silver: DataFrame, exceptions: DataFrame
) -> CustomerSummary:
    """Check the references, collect all exceptions, build and reconcile the gold table."""
    customer_rows = materialize(check_customers(read_reference_csv(spark, customer_csv, CUSTOMER_COLUMNS)), "customers")
    customers = accepted(customer_rows, CUSTOMER_COLUMNS)
    if customers.isEmpty():
        raise ValueError("No valid customer records were loaded")
    account_rows = materialize(
        check_accounts(read_reference_csv(spark, account_csv, ACCOUNT_COLUMNS), customers), "accounts"
    )
    accounts = accepted(account_rows, ACCOUNT_COLUMNS)
    silver_rows = check_silver(silver, accounts)

    def raw(df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in ("source_filename", "source_row_number", "row_issues", "reasons")]

    found = materialize(
        stack(
            [
                exception_records(customer_rows, CUSTOMER, raw(customer_rows)),
                exception_records(account_rows, ACCOUNT, raw(account_rows)),
                import_exceptions(exceptions, accounts),
                exception_records(silver_rows, TRANSACTION, TRANSACTION_COLUMNS),
            ]
        ),
        "customer-exceptions",
    )
    gold = materialize(customer_360(customers, accounts, silver), "customer-gold")
    assert_grain(gold, "customer_id")
    figures = reconcile(gold, silver, accounts).first()
    assert_gold_reconciled(figures)
    sizes = stack(
        [
            df.agg(F.count("*").cast("string").alias("value")).select(F.lit(name).alias("metric"), "value")
            for name, df in [
                ("customers_loaded", customers),
                ("accounts_loaded", accounts),
                ("silver_transactions_total", silver),
                ("customer_360_rows", gold),
                ("exceptions_total", found),
                ("earlier_exceptions_imported", exceptions),
                ("unmapped_silver_transactions_found", silver_rows.filter(F.array_contains("reasons", R.ACCOUNT_UNMAPPED))),
            ]
        ]
    )
    by_entity = exceptions_by_entity(found).select(
        F.concat(F.lit("exceptions_by_entity: "), "entity_type").alias("metric"),
        F.col("exception_count").cast("string").alias("value"),
    )
    reconciled = spark.createDataFrame([(k, str(v)) for k, v in figures.asDict().items()], "metric string, value string")
    return CustomerSummary(customers, accounts, gold, found, stack([sizes, by_entity, reconciled]))


def publish_customer_summary(built: CustomerSummary, base: str, version: str) -> tuple[int, int]:
    """Publish gold and exceptions as checked versions; returns their rows."""
    gold = publish(
        built.gold, f"{base}/customer_360", version, ["customer_id"], ["customer_id"]
    )
    shown = built.exceptions.withColumn("recorded_at", utc_text(F.col("recorded_at")))
    found = publish(
        built.exceptions.select(*CUSTOMER_EXCEPTION_COLUMNS),
        f"{base}/customer360_exceptions",
        version,
        ["raw_record", "rejection_reasons"],
        ["entity_type", "source_filename", "source_row_number"],
        shown.select(*CUSTOMER_EXCEPTION_COLUMNS),
    )
    return gold, found
