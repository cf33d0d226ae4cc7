"""Layered models: staging, intermediate and marts, with their data tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import INFLOW_TYPES, OUTFLOW_TYPES
from ledgerloom.operators.aggregates import daily_account_activity
from ledgerloom.operators.quality import (
    ColumnTest,
    accepted,
    has_parent,
    is_negative_amount,
    never,
    not_null,
    run_tests,
    unique,
)
from ledgerloom.operators.transforms import cleansed, with_flow_amount


def staged_customers(raw: DataFrame) -> DataFrame:
    return cleansed(raw, customer_id="key", customer_name="text", city="text", customer_segment="text")


def staged_accounts(raw: DataFrame) -> DataFrame:
    return cleansed(
        raw, account_id="key", customer_id="key", account_type="text", opened_date="date", account_status="code"
    )


def staged_transactions(raw: DataFrame) -> DataFrame:
    return cleansed(
        raw, transaction_id="key", account_id="key", transaction_date="date", amount="money",
        transaction_type="code", currency="code",
    )


def enriched_transactions(tx: DataFrame, accounts: DataFrame, customers: DataFrame) -> DataFrame:
    """Transactions with account, customer and signed amount; unmatched rows drop out.

    Accounts and customers join first, so the facts move once.
    """
    owners = accounts.join(customers, "customer_id")
    return with_flow_amount(tx.join(owners, "account_id")).select(
        "transaction_id", "account_id", "customer_id", "customer_name", "city", "customer_segment",
        "account_type", "opened_date", "account_status", "transaction_date", "amount",
        "transaction_type", "currency", "signed_amount",
    )


def account_dimension(accounts: DataFrame, customers: DataFrame) -> DataFrame:
    """Every account with its customer, NULL where the customer is unknown."""
    return accounts.join(customers, "customer_id", "left").select(
        "account_id", "customer_id", "customer_name", "city", "customer_segment",
        "account_type", "opened_date", "account_status",
    )


def daily_activity(tx: DataFrame, accounts: DataFrame, customers: DataFrame) -> DataFrame:
    """Daily figures per account of the enriched transactions.

    The enrichment only decides which accounts count, so facts fold first and the surviving
    accounts are picked from the much smaller result.
    """
    known = accounts.join(customers.select("customer_id"), "customer_id", "left_semi").select("account_id")
    return daily_account_activity(tx).join(known, "account_id", "left_semi").select(
        "transaction_date", "account_id", "transaction_count", "total_deposits", "total_outflows", "net_amount"
    )


def build_layers(customers: DataFrame, accounts: DataFrame, transactions: DataFrame) -> dict[str, DataFrame]:
    """All six models from the three raw tables."""
    c, a, t = staged_customers(customers), staged_accounts(accounts), staged_transactions(transactions)
    return {
        "stg_customers": c,
        "stg_accounts": a,
        "stg_transactions": t,
        "int_transaction_enriched": enriched_transactions(t, a, c),
        "dim_accounts": account_dimension(a, c),
        "fct_daily_account_activity": daily_activity(t, a, c),
    }


def data_tests(
    layers: dict[str, DataFrame], raw_transactions: DataFrame
) -> list[tuple[DataFrame, dict[str, ColumnTest]]]:
    """Twelve tests, grouped by the table that they read."""
    c, a, t = layers["stg_customers"], layers["stg_accounts"], layers["stg_transactions"]
    return [
        (
            c,
            {
                "unique_stg_customers_customer_id": unique("customer_id"),
                "not_null_stg_customers_customer_id": not_null("customer_id"),
            },
        ),
        (
            a,
            {
                "unique_stg_accounts_account_id": unique("account_id"),
                "not_null_stg_accounts_account_id": not_null("account_id"),
                "not_null_stg_accounts_customer_id": not_null("customer_id"),
                "relationships_stg_accounts_customer_id": has_parent("customer_id", c, "customer_id"),
            },
        ),
        (
            t,
            {
                "unique_stg_transactions_transaction_id": unique("transaction_id"),
                "not_null_stg_transactions_transaction_id": not_null("transaction_id"),
                "not_null_stg_transactions_account_id": not_null("account_id"),
                "relationships_stg_transactions_account_id": has_parent("account_id", a, "account_id"),
                "accepted_values_stg_transactions_transaction_type": accepted(
                    "transaction_type", [*INFLOW_TYPES, *OUTFLOW_TYPES]
                ),
            },
        ),
        (
            raw_transactions,
            {"assert_nonnegative_transaction_amount": never("amount", is_negative_amount(F.col("amount")))},
        ),
    ]


def layer_test_results(layers: dict[str, DataFrame], raw_transactions: DataFrame) -> DataFrame:
    return run_tests(data_tests(layers, raw_transactions))
