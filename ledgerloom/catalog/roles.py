"""The driver's tables in the roles of the account-transaction model, for Spark and as SQL CTEs.

account = orders, customer = customer, branch = nation (city: nation name, state: region name),
transaction = lineitem. ``*_SQL`` hold the same mapping for the SQL side.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.functions.money import money
from ledgerloom.plans.operational import Frames


@cache
def _schema(path: str) -> StructType:
    """Schema of a driver table, read from a footer once per process."""
    return SparkSession.active().read.parquet(path).schema


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    return spark.read.schema(_schema(path)).parquet(path)


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as transactions. The id is the line's own key and repeats where that key does."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
        F.col("l_orderkey").alias("account_id"),
        F.col("l_shipdate").cast("date").alias("transaction_date"),
        F.when(F.col("l_linestatus") == "F", "CREDIT").otherwise("DEBIT").alias("transaction_type"),
        money(F.col("l_extendedprice")).alias("amount"),
        F.lit("USD").alias("currency"),
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as transactions with a unique id; the account is the customer."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.when(F.col("o_orderstatus") == "F", "CREDIT").otherwise("DEBIT").alias("transaction_type"),
        money(F.col("o_totalprice")).alias("amount"),
        F.lit("USD").alias("currency"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.col("c_mktsegment").alias("customer_segment"),
    )


def branches(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("branch_id"),
        F.col("n_name").alias("branch_name"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
    )


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as accounts; the branch is the customer's nation."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    return orders.join(
        customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"
    ).select(
        F.col("o_orderkey").alias("account_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("c_nationkey").alias("branch_id"),
        F.col("o_orderpriority").alias("account_type"),
        F.col("o_orderstatus").alias("account_status"),
    )


def frames(spark: SparkSession, folder: str) -> Frames:
    return Frames(
        tx=transactions(spark, folder),
        account=accounts(spark, folder),
        customer=customers(spark, folder),
        branch=branches(spark, folder),
    )


MONEY_SQL = "DECIMAL(18,2)"

TX_SQL = """tx AS (
    SELECT l_orderkey * 10 + l_linenumber AS transaction_id, l_orderkey AS account_id,
           CAST(l_shipdate AS DATE) AS transaction_date,
           CASE WHEN l_linestatus = 'F' THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type,
           CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, 'USD' AS currency
    FROM lineitem)"""

PAYMENT_SQL = """pay AS (
    SELECT o_orderkey AS transaction_id, o_custkey AS account_id,
           CAST(o_orderdate AS DATE) AS transaction_date,
           CASE WHEN o_orderstatus = 'F' THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type,
           CAST(o_totalprice AS DECIMAL(18,2)) AS amount, 'USD' AS currency
    FROM orders)"""

CUSTOMER_SQL = """cust AS (
    SELECT c_custkey AS customer_id, c_name AS customer_name,
           lower(c_name) || '@example.com' AS email, c_mktsegment AS customer_segment
    FROM customer)"""

BRANCH_SQL = """branch AS (
    SELECT n_nationkey AS branch_id, n_name AS branch_name, n_name AS city, r_name AS state
    FROM nation JOIN region ON n_regionkey = r_regionkey)"""

ACCOUNT_SQL = """account AS (
    SELECT o_orderkey AS account_id, o_custkey AS customer_id, c_nationkey AS branch_id,
           o_orderpriority AS account_type, o_orderstatus AS account_status
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def with_roles(body: str, *more: str) -> str:
    """SQL with all roles (and further CTEs) in front."""
    return "WITH " + ",\n".join([TX_SQL, PAYMENT_SQL, CUSTOMER_SQL, BRANCH_SQL, ACCOUNT_SQL, *more]) + "\n" + body


def mean_sql(total: str, rows: str) -> str:
    """Exact half-up mean of a non-negative money total, as DOUBLE."""
    cents = f"CAST({total} * 100 AS HUGEINT)"
    return f"CAST((2 * {cents} + {rows}) // (2 * {rows}) AS DOUBLE) / 100"


def dbl(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"
