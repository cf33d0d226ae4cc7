"""Row rules: every row keeps the texts of all rules it breaks, in rule order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import flexible_date, strict_date
from ledgerloom.functions.money import CURRENCY, TRANSACTION_TYPES, is_plain_positive, parse_money
from ledgerloom.functions.text import (
    broken_mask,
    clean_upper,
    first_reason,
    is_missing,
    join_reasons,
    masked_reasons,
    strip,
)

# Reason texts and their order.
ID_MISSING = "transaction_id is missing"
ACCOUNT_MISSING = "account_id is missing"
BAD_DATE = "transaction_date must be a valid date in YYYY-MM-DD format"
BAD_TYPE = "transaction_type must be CREDIT or DEBIT"
BAD_AMOUNT = "amount must be present, numeric, and greater than 0"
BAD_CURRENCY = "currency must be USD"
UNKNOWN_ACCOUNT = "account_id not found in accounts reference"
REPEATED_ID = "duplicate transaction_id across combined branch data"
ALREADY_ACCEPTED = "duplicate transaction_id already accepted (first accepted record wins)"

# an amount that breaks no rule and that the money type cannot hold
BEYOND_MONEY = "amount has more than 16 whole digits"

# Reason texts of the customer summary's reference and silver checks.
CUSTOMER_ID_MISSING = "customer_id is missing"
CUSTOMER_NAME_MISSING = "customer_name is missing"
CUSTOMER_SEGMENT_MISSING = "customer_segment is missing"
CUSTOMER_REPEATED = "duplicate customer_id; first valid record wins"
BRANCH_ID_MISSING = "branch_id is missing"
ACCOUNT_TYPE_MISSING = "account_type is missing"
ACCOUNT_STATUS_MISSING = "account_status is missing"
ACCOUNT_REPEATED = "duplicate account_id; first valid record wins"
CUSTOMER_UNKNOWN = "customer_id not found in customers reference"
SILVER_REPEATED = "duplicate transaction_id in Silver"
ACCOUNT_UNMAPPED = "account_id not found in Customer 360 accounts reference"
DATE_MISSING = "transaction_date is missing"
TYPE_MISSING = "transaction_type is missing"
AMOUNT_MISSING = "amount is missing"
CURRENCY_MISSING = "currency is missing"
EARLIER_REJECTION = "Week 8 transaction rejected"

# Outcome texts of the upsert normalizer.
UNREADABLE_AMOUNT = "could not convert amount to a number"
INVALID_TYPE = "Invalid transaction type"
NOT_POSITIVE = "Amount must be positive"
UNSUPPORTED_CURRENCY = "Unsupported currency"
UNREADABLE_DATE = "Unrecognized date format"
BLANK_ID = "transaction_id is missing"

Rules = list[tuple[str, Column]]


def _not_in(col: Column, allowed: list[str]) -> Column:
    return ~F.coalesce(col.isin(allowed), F.lit(False))


def value_rules() -> Rules:
    """The six rules that look at one value of an all-text transaction row."""
    return [
        (ID_MISSING, is_missing(F.col("transaction_id"))),
        (ACCOUNT_MISSING, is_missing(F.col("account_id"))),
        (BAD_DATE, strict_date(F.col("transaction_date")).isNull()),
        (BAD_TYPE, _not_in(F.col("transaction_type"), TRANSACTION_TYPES)),
        (BAD_AMOUNT, ~is_plain_positive(F.col("amount"))),
        (BAD_CURRENCY, _not_in(F.col("currency"), [CURRENCY])),
    ]


def with_verdict(df: DataFrame, rules: Rules) -> DataFrame:
    """Add ``reasons`` (array), ``error_reason`` (text, empty when valid) and ``is_valid``."""
    texts = [text for text, _ in rules]
    return (
        df.withColumn("__mask", broken_mask(rules))
        .withColumns({"reasons": masked_reasons(F.col("__mask"), texts), "is_valid": F.col("__mask") == 0})
        .withColumn("error_reason", F.when(F.col("is_valid"), "").otherwise(join_reasons(F.col("reasons"))))
        .drop("__mask")
    )


def customer_rules() -> Rules:
    """Rules of a customer reference row (values already stripped)."""
    return [
        (CUSTOMER_ID_MISSING, F.col("customer_id") == ""),
        (CUSTOMER_NAME_MISSING, F.col("customer_name") == ""),
        (CUSTOMER_SEGMENT_MISSING, F.col("customer_segment") == ""),
    ]


def account_rules() -> Rules:
    """Rules of an account reference row (values already stripped)."""
    return [
        (ACCOUNT_MISSING, F.col("account_id") == ""),
        (CUSTOMER_ID_MISSING, F.col("customer_id") == ""),
        (BRANCH_ID_MISSING, F.col("branch_id") == ""),
        (ACCOUNT_TYPE_MISSING, F.col("account_type") == ""),
        (ACCOUNT_STATUS_MISSING, F.col("account_status") == ""),
    ]


def upsert_rules() -> Rules:
    """Rules over already normalized columns; the first failing one rejects the row."""
    return [
        (UNREADABLE_AMOUNT, F.col("amount").isNull()),
        (INVALID_TYPE, _not_in(F.col("transaction_type"), TRANSACTION_TYPES)),
        (NOT_POSITIVE, F.col("amount") <= 0),
        (UNSUPPORTED_CURRENCY, _not_in(F.col("currency"), [CURRENCY])),
        (UNREADABLE_DATE, F.col("transaction_date").isNull()),
        (BLANK_ID, is_missing(F.col("transaction_id"))),
    ]


def normalized(df: DataFrame) -> DataFrame:
    """Clean daily rows: stripped, upper-cased, typed, with ``reject_reason`` or NULL.

    Every value is parsed once; the rules look at the parsed columns.
    """
    return df.withColumns(
        {
            "transaction_id": strip(F.col("transaction_id")),
            "account_id": strip(F.col("account_id")),
            "transaction_date": flexible_date(strip(F.col("transaction_date"))),
            "transaction_type": clean_upper(F.col("transaction_type")),
            "amount": parse_money(strip(F.col("amount"))),
            "currency": clean_upper(F.col("currency")),
        }
    ).withColumn("reject_reason", first_reason(upsert_rules()))
