"""Aggregation operators.

Transactions are always folded to one row per account (or per grouping key) before they meet
another table: the map side already collapses a hot account, and the joins that follow move
rolled-up rows instead of facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import (
    CREDIT,
    DEBIT,
    INFLOW_TYPES,
    OUTFLOW_TYPES,
    cents,
    flow_amount,
    mean_money,
    signed_amount,
    sum_cents,
    sum_money,
)

# measure name -> function that merges partial results
MEASURES = {
    "transaction_count": F.sum,
    "gross_amount": F.sum,
    "net_cash_flow": F.sum,
    "total_credits": F.sum,
    "total_debits": F.sum,
    "minimum_amount": F.min,
    "maximum_amount": F.max,
    "last_transaction_date": F.max,
}


def _first_level() -> dict[str, Column]:
    kind, amount = F.col("transaction_type"), cents(F.col("amount"))
    return {
        "transaction_count": F.count("*"),
        "gross_amount": sum_cents(amount),
        "net_cash_flow": sum_cents(signed_amount(kind, amount)),
        "total_credits": sum_cents(F.when(kind == CREDIT, amount).otherwise(0)),
        "total_debits": sum_cents(F.when(kind == DEBIT, amount).otherwise(0)),
        "minimum_amount": F.min("amount"),
        "maximum_amount": F.max("amount"),
        "last_transaction_date": F.max("transaction_date"),
    }


def roll_up(tx: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """The named measures per key straight from transactions."""
    level = _first_level()
    return tx.groupBy(*keys).agg(*[level[m].alias(m) for m in measures])


def fold(partial: DataFrame, keys: list[str]) -> DataFrame:
    """Merge rolled-up rows to coarser keys, keeping every measure present."""
    present = [c for c in partial.columns if c in MEASURES]
    merged = []
    for name in present:
        value = MEASURES[name](F.col(name))
        if name == "transaction_count":
            value = value.cast("long")
        merged.append(value.alias(name))
    return partial.groupBy(*keys).agg(*merged)


def per_account(tx: DataFrame, measures: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    return roll_up(tx, ["account_id", *extra], measures)


def by_type(tx: DataFrame) -> DataFrame:
    """Count, total and average per transaction type."""
    return roll_up(tx, ["transaction_type"], ["transaction_count", "gross_amount"]).select(
        "transaction_type",
        "transaction_count",
        F.col("gross_amount").alias("total_amount"),
        mean_money(F.col("gross_amount"), F.col("transaction_count")).alias("avg_amount"),
    )


BASIC = ["transaction_count", "gross_amount", "net_cash_flow"]


def by_account(tx: DataFrame) -> DataFrame:
    return per_account(tx, BASIC)


def by_branch(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """Count, gross and net per branch over transactions whose account is known."""
    placed = per_account(tx, BASIC).join(accounts.select("account_id", "branch_id"), "account_id")
    return fold(placed, ["branch_id"])


def activity_by(
    tx: DataFrame,
    accounts: DataFrame,
    group_by: list[str],
    measures: list[str] = BASIC,
    customers: DataFrame | None = None,
    branches: DataFrame | None = None,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Measures per any columns of account, customer and branch, as over their inner join.

    Facts fold to accounts, accounts to customer and branch ids, and only then are names attached.
    A table that is given but contributes no column still drops rows without a match.
    ``extra`` adds transaction columns to the grouping.
    """
    parents = [("customer_id", customers), ("branch_id", branches)]
    named = {
        key: [c for c in table.columns if c in group_by and c not in accounts.columns]
        for key, table in parents
        if table is not None
    }
    ids = [c for c in group_by if c in accounts.columns]
    ids += [key for key, cols in named.items() if cols and key not in ids]
    known = accounts
    for key, table in parents:
        if table is not None and not named[key]:
            known = known.join(table.select(key), key, "left_semi")
    known = known.select("account_id", *[c for c in ids if c != "account_id"])
    folded = per_account(tx, measures, extra).join(known, "account_id")
    if "account_id" not in ids or extra:
        folded = fold(folded, [*ids, *extra])
    for key, table in parents:
        if table is not None and named[key]:
            folded = folded.join(table.select(key, *named[key]), key)
    if not set(ids) <= set(group_by):
        folded = fold(folded, [*group_by, *extra])
    return folded.select(*group_by, *extra, *measures)


def grand_total(tx: DataFrame) -> DataFrame:
    return tx.agg(sum_money(F.col("amount")).alias("total_transaction_amount"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of many tables in one job."""
    parts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def duplicate_groups(df: DataFrame, column: str) -> DataFrame:
    """Number of values that occur more than once (column ``bad``)."""
    return df.groupBy(column).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("bad"))


def grain(df: DataFrame, key: str) -> DataFrame:
    """Rows against distinct keys."""
    return df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("distinct_keys"))


def reason_counts(df: DataFrame, reasons: str = "reasons") -> DataFrame:
    """How often each reason occurs, most frequent first when ordered at the edge."""
    return (
        df.select(F.explode(reasons).alias("reason"))
        .groupBy("reason")
        .agg(F.count("*").alias("rows"))
    )


def daily_account_activity(enriched: DataFrame) -> DataFrame:
    """Count, inflows, outflows and net per account and business date."""
    kind, amount = F.col("transaction_type"), cents(F.col("amount"))
    return enriched.groupBy("transaction_date", "account_id").agg(
        F.count("*").alias("transaction_count"),
        sum_cents(F.when(kind.isin(INFLOW_TYPES), amount).otherwise(0)).alias("total_deposits"),
        sum_cents(F.when(kind.isin(OUTFLOW_TYPES), amount).otherwise(0)).alias("total_outflows"),
        sum_cents(flow_amount(kind, amount)).alias("net_amount"),
    )


def branch_daily_summary(silver: DataFrame) -> DataFrame:
    """Count and total per branch, business date and type."""
    return silver.groupBy("branch_id", "transaction_date", "transaction_type").agg(
        F.count("*").alias("transaction_count"), sum_money(F.col("amount")).alias("total_amount")
    )
