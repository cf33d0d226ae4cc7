"""Reporting queries over the operational tables, each ``(frames) -> DataFrame``.

``tx`` has transaction_id, account_id, transaction_date, transaction_type, amount, currency.
Output order is left to the caller; :data:`ORDER_BY` names it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import mean_money
from ledgerloom.operators.aggregates import activity_by, grand_total, per_account, roll_up
from ledgerloom.operators.ordered import (
    rank_descending,
    running_sum,
    with_percent_of_total,
)
from ledgerloom.operators.transforms import with_amount_band


@dataclass(frozen=True)
class Frames:
    """The tables a query may use."""

    tx: DataFrame
    account: DataFrame
    customer: DataFrame
    branch: DataFrame


COUNT_TOTAL = ["transaction_count", "gross_amount"]


def _average(total: str = "gross_amount"):
    return mean_money(F.col(total), F.col("transaction_count"))


def transactions_with_customer(t: Frames) -> DataFrame:
    """Transaction detail with its account's customer; the references join each other first."""
    owners = t.account.select("account_id", "customer_id").join(
        t.customer.select("customer_id", "customer_name"), "customer_id"
    )
    return t.tx.join(owners, "account_id").select(
        "transaction_id", "transaction_date", "transaction_type", "amount", "currency",
        "account_id", "customer_id", "customer_name",
    )


def transactions_with_branch(t: Frames) -> DataFrame:
    places = t.account.select("account_id", "branch_id").join(
        t.branch.select("branch_id", "branch_name", "city", "state"), "branch_id"
    )
    return t.tx.join(places, "account_id").select(
        "transaction_id", "transaction_date", "transaction_type", "amount", "account_id",
        "branch_id", "branch_name", "city", "state",
    )


def total_amount(t: Frames) -> DataFrame:
    return grand_total(t.tx)


def summary_by_type(t: Frames) -> DataFrame:
    return roll_up(t.tx, ["transaction_type"], COUNT_TOTAL).select(
        "transaction_type", "transaction_count",
        F.col("gross_amount").alias("total_amount"), _average().alias("average_amount"),
    )


def summary_by_customer(t: Frames) -> DataFrame:
    keys = ["customer_id", "customer_name", "customer_segment"]
    return activity_by(t.tx, t.account, keys, COUNT_TOTAL, customers=t.customer).select(
        *keys, "transaction_count",
        F.col("gross_amount").alias("total_transaction_amount"),
        _average().alias("average_transaction_amount"),
    )


def summary_by_branch(t: Frames) -> DataFrame:
    keys = ["branch_id", "branch_name", "city"]
    return activity_by(t.tx, t.account, keys, COUNT_TOTAL, branches=t.branch).select(
        *keys, "transaction_count",
        F.col("gross_amount").alias("total_transaction_amount"),
        _average().alias("average_transaction_amount"),
    )


def amount_bands(t: Frames) -> DataFrame:
    return with_amount_band(t.tx).select(
        "transaction_id", "account_id", "transaction_type", "amount", "amount_band"
    )


def range_by_type(t: Frames) -> DataFrame:
    return roll_up(
        t.tx, ["transaction_type"], [*COUNT_TOTAL, "minimum_amount", "maximum_amount"]
    ).select(
        "transaction_type", "transaction_count",
        F.col("gross_amount").alias("total_amount"), _average().alias("average_amount"),
        "minimum_amount", "maximum_amount",
    )


def customer_totals(t: Frames) -> DataFrame:
    return activity_by(
        t.tx, t.account, ["customer_id", "customer_name"], ["gross_amount"], customers=t.customer
    ).withColumnRenamed("gross_amount", "total_amount")


def customer_ranking(t: Frames) -> DataFrame:
    return rank_descending(customer_totals(t), "total_amount", "customer_rank")


def running_total(t: Frames) -> DataFrame:
    rows = t.tx.select("transaction_id", "transaction_date", "transaction_type", "amount")
    return running_sum(rows, ["transaction_date", "transaction_id"], "amount", "running_total")


def account_activity(t: Frames) -> DataFrame:
    """Every account, also those without transactions: their sums stay NULL."""
    folded = per_account(t.tx, COUNT_TOTAL)
    return t.account.join(folded, "account_id", "left").select(
        "account_id", "account_type", "account_status",
        F.coalesce("transaction_count", F.lit(0)).cast("long").alias("transaction_count"),
        F.col("gross_amount").alias("total_amount"), _average().alias("average_amount"),
    )


def customer_accounts(t: Frames) -> DataFrame:
    return (
        t.account.join(t.customer.select("customer_id", "customer_name"), "customer_id")
        .join(t.branch.select("branch_id", "branch_name", "city"), "branch_id")
        .select("customer_id", "customer_name", "account_id", "account_type", "branch_name", "city")
    )


def branch_by_type(t: Frames) -> DataFrame:
    return activity_by(
        t.tx, t.account, ["branch_id", "branch_name"], COUNT_TOTAL,
        branches=t.branch, extra=("transaction_type",),
    ).withColumnRenamed("gross_amount", "total_amount")


def above_average_customers(t: Frames) -> DataFrame:
    """Customers above the mean customer total; compared without dividing, so exactly."""
    totals = customer_totals(t)
    mean = totals.agg(
        F.struct(F.sum("total_amount").alias("total"), F.count("*").alias("customers")).alias("m")
    ).scalar()
    return (
        totals.withColumn("m", mean)
        .filter(F.col("total_amount") * F.col("m.customers") > F.col("m.total"))
        .select(
            "customer_id", "customer_name", "total_amount",
            mean_money(F.col("m.total"), F.col("m.customers")).alias("average_customer_total"),
        )
    )


def customer_share(t: Frames) -> DataFrame:
    return with_percent_of_total(customer_totals(t), "total_amount", "percentage_of_total")


QUERIES = {
    "transactions_with_customer": transactions_with_customer,
    "transactions_with_branch": transactions_with_branch,
    "total_amount": total_amount,
    "summary_by_type": summary_by_type,
    "summary_by_customer": summary_by_customer,
    "summary_by_branch": summary_by_branch,
    "amount_bands": amount_bands,
    "range_by_type": range_by_type,
    "customer_ranking": customer_ranking,
    "running_total": running_total,
    "account_activity": account_activity,
    "customer_accounts": customer_accounts,
    "branch_by_type": branch_by_type,
    "above_average_customers": above_average_customers,
    "customer_share": customer_share,
}

# query -> columns its report is sorted by; "-" marks descending
ORDER_BY = {
    "transactions_with_customer": ["transaction_date", "transaction_id"],
    "transactions_with_branch": ["branch_id", "transaction_id"],
    "summary_by_type": ["transaction_type"],
    "summary_by_customer": ["-total_transaction_amount"],
    "summary_by_branch": ["-total_transaction_amount"],
    "amount_bands": ["-amount"],
    "range_by_type": ["-total_amount"],
    "customer_ranking": ["customer_rank"],
    "running_total": ["transaction_date", "transaction_id"],
    "account_activity": ["-total_amount"],
    "customer_accounts": ["customer_id", "account_id"],
    "branch_by_type": ["branch_id", "transaction_type"],
    "above_average_customers": ["-total_amount"],
    "customer_share": ["-percentage_of_total"],
}


def ordered(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sort for presentation; NULLs come last in descending order."""
    return df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in columns])


def report(name: str, t: Frames) -> DataFrame:
    """A named query in its presentation order."""
    result = QUERIES[name](t)
    return ordered(result, ORDER_BY[name]) if name in ORDER_BY else result
