"""Star schema and the queries over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.dates import date_key
from ledgerloom.operators.aggregates import activity_by, distinct_values, fold, roll_up
from ledgerloom.operators.transforms import with_date_parts
from ledgerloom.plans.operational import Frames, ordered
from ledgerloom.sinks.together import publish_together, read_together


@dataclass(frozen=True)
class Star:
    """The star tables. ``origin`` is set while they are views over operational tables."""

    dim_customer: DataFrame
    dim_account: DataFrame
    dim_branch: DataFrame
    dim_date: DataFrame
    fact_transaction: DataFrame
    origin: Frames | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {name: df for name, df in vars(self).items() if name != "origin"}


def load_star(spark: SparkSession, base: str) -> Star:
    """Star tables of the last :func:`rebuild_star` that ended, all of the same one."""
    return Star(**read_together(spark, base))


def build_star(t: Frames) -> Star:
    """Four dimensions and one fact; customer and branch of a fact come from its account."""
    fact = t.tx.join(t.account.select("account_id", "customer_id", "branch_id"), "account_id").select(
        "transaction_id", "account_id", "customer_id", "branch_id",
        date_key(F.col("transaction_date")).alias("date_key"),
        "transaction_type", "amount", "currency",
    )
    return Star(
        dim_customer=t.customer.select("customer_id", "customer_name", "email", "customer_segment"),
        dim_account=t.account.select("account_id", "account_type", "account_status"),
        dim_branch=t.branch.select("branch_id", "branch_name", "city", "state"),
        dim_date=with_date_parts(distinct_values(t.tx, "transaction_date"), "transaction_date"),
        fact_transaction=fact,
        origin=t,
    )


def rebuild_star(t: Frames, base: str) -> int:
    """Replace all star tables at one instant; returns the number of the build."""
    return publish_together(build_star(t).tables(), base)


def _per(s: Star, keys: list[str], measures: list[str]) -> DataFrame:
    """Fact measures per key. Over views the facts fold to accounts before the account join."""
    if s.origin is None:
        return roll_up(s.fact_transaction, keys, measures)
    ids = [k for k in keys if k in ("account_id", "customer_id", "branch_id")]
    own = tuple({"date_key": "transaction_date"}.get(k, k) for k in keys if k not in ids)
    folded = activity_by(s.origin.tx, s.origin.account, ids, measures, extra=own)
    if "date_key" in keys:
        folded = folded.withColumn("date_key", date_key(F.col("transaction_date")))
    return folded.select(*keys, *measures)


COUNT_GROSS = ["transaction_count", "gross_amount"]
FLOWS = ["total_credits", "total_debits", "net_cash_flow"]


def by_branch(s: Star) -> DataFrame:
    folded = _per(s, ["branch_id"], [*COUNT_GROSS, "net_cash_flow"])
    return folded.join(s.dim_branch, "branch_id").select(
        "branch_id", "branch_name", "transaction_count",
        F.col("gross_amount").alias("total_amount"), "net_cash_flow",
    )


def by_type(s: Star) -> DataFrame:
    return _per(s, ["transaction_type"], COUNT_GROSS).withColumnRenamed("gross_amount", "total_amount")


def by_customer(s: Star) -> DataFrame:
    folded = _per(s, ["customer_id"], ["transaction_count", *FLOWS])
    return folded.join(s.dim_customer, "customer_id").select(
        "customer_id", "customer_name", "customer_segment", "transaction_count", *FLOWS
    )


def by_account(s: Star) -> DataFrame:
    folded = _per(s, ["account_id"], COUNT_GROSS)
    return folded.join(s.dim_account, "account_id").select(
        "account_id", "account_type", "transaction_count", F.col("gross_amount").alias("total_amount")
    )


def by_date(s: Star) -> DataFrame:
    folded = _per(s, ["date_key"], [*COUNT_GROSS, "net_cash_flow"])
    return folded.join(s.dim_date, "date_key").select(
        "full_date", "day_name", "transaction_count",
        F.col("gross_amount").alias("total_amount"), "net_cash_flow",
    )


def by_segment_and_branch(s: Star) -> DataFrame:
    """Fold to (customer, branch) ids before either dimension is touched, then to their names."""
    folded = (
        _per(s, ["customer_id", "branch_id"], COUNT_GROSS)
        .join(s.dim_customer.select("customer_id", "customer_segment"), "customer_id")
    )
    folded = fold(folded, ["customer_segment", "branch_id"]).join(
        s.dim_branch.select("branch_id", "branch_name"), "branch_id"
    )
    return fold(folded, ["customer_segment", "branch_name"]).withColumnRenamed("gross_amount", "total_amount")


def net_outflow_accounts(s: Star) -> DataFrame:
    folded = _per(s, ["account_id"], FLOWS).filter(F.col("net_cash_flow") < 0)
    return folded.join(s.dim_account, "account_id").select("account_id", "account_type", *FLOWS)


QUERIES = {
    "by_branch": by_branch,
    "by_type": by_type,
    "by_customer": by_customer,
    "by_account": by_account,
    "by_date": by_date,
    "by_segment_and_branch": by_segment_and_branch,
    "net_outflow_accounts": net_outflow_accounts,
}

ORDER_BY = {
    "by_branch": ["branch_id"],
    "by_type": ["transaction_type"],
    "by_customer": ["-transaction_count", "customer_id"],
    "by_account": ["-total_amount", "account_id"],
    "by_date": ["full_date"],
    "by_segment_and_branch": ["customer_segment", "branch_name"],
    "net_outflow_accounts": ["net_cash_flow", "account_id"],
}


def report(name: str, s: Star) -> DataFrame:
    return ordered(QUERIES[name](s), ORDER_BY[name])
