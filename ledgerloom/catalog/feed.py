"""An untidy delivery derived from all line items: text rows in named files, with every fault.

Which fault a row has follows from its own values, so both sides derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog.roles import table
from ledgerloom.functions.money import money
from ledgerloom.operators.rules import (
    ACCOUNT_MISSING,
    BAD_AMOUNT,
    BAD_CURRENCY,
    BAD_DATE,
    BAD_TYPE,
    ID_MISSING,
)

FEED_SQL = f"""feed AS (
    SELECT 'BR00' || (l_linenumber + 10 * (l_orderkey // 200000)) || '_' || year(l_shipdate) || '0101_TRANSACTION.csv' AS source_file,
           'BR00' || (l_linenumber + 10 * (l_orderkey // 200000)) AS branch_id, make_date(year(l_shipdate), 1, 1) AS file_date,
           l_partkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS place,
           CASE WHEN l_tax = 0 AND l_discount = 0 THEN '' ELSE 'T' || l_orderkey || '-' || l_linenumber END AS transaction_id,
           CASE WHEN l_quantity = 1 THEN '  ' ELSE CAST(l_orderkey AS VARCHAR) END AS account_id,
           CASE WHEN l_tax = 0.08 THEN strftime(l_shipdate, '%Y/%m/%d') WHEN l_tax = 0.07 THEN '2026-02-30'
                ELSE strftime(l_shipdate, '%Y-%m-%d') END AS transaction_date,
           CASE WHEN l_quantity = 50 THEN 'TRANSFER' WHEN l_linestatus = 'F' THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type,
           CASE l_quantity WHEN 2 THEN '' WHEN 3 THEN '-' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)
                WHEN 4 THEN '0.00' WHEN 5 THEN '1e10'
                ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount,
           CASE WHEN l_discount = 0.1 THEN 'EUR' ELSE 'USD' END AS currency,
           l_orderkey, l_linenumber, l_quantity, l_tax, l_discount
    FROM lineitem),
ruled AS (
    SELECT *, l_tax = 0 AND l_discount = 0 AS no_id, l_quantity = 1 AS no_account,
        concat_ws('; ',
            CASE WHEN l_tax = 0 AND l_discount = 0 THEN '{ID_MISSING}' END,
            CASE WHEN l_quantity = 1 THEN '{ACCOUNT_MISSING}' END,
            CASE WHEN l_tax >= 0.07 THEN '{BAD_DATE}' END,
            CASE WHEN l_quantity = 50 THEN '{BAD_TYPE}' END,
            CASE WHEN l_quantity IN (2, 3, 4, 5) THEN '{BAD_AMOUNT}' END,
            CASE WHEN l_discount = 0.1 THEN '{BAD_CURRENCY}' END) AS value_reasons
    FROM feed)"""


def feed(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    price = money(F.col("l_extendedprice")).cast("string")
    # more orders make more branches, so a file stays small whatever the scale
    number = F.col("l_linenumber") + 10 * F.floor(F.col("l_orderkey") / 200000)
    branch = F.concat(F.lit("BR00"), number.cast("string"))
    year = F.year("l_shipdate")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    quantity, tax = F.col("l_quantity"), F.col("l_tax")
    return line.select(
        F.concat(branch, F.lit("_"), year.cast("string"), F.lit("0101_TRANSACTION.csv")).alias("source_file"),
        branch.alias("branch_id"),
        F.make_date(year, F.lit(1), F.lit(1)).alias("file_date"),
        (F.col("l_partkey") * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("place"),
        F.when((tax == 0) & (F.col("l_discount") == 0), "")
        .otherwise(F.concat(F.lit("T"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")))
        .alias("transaction_id"),
        F.when(quantity == 1, "  ").otherwise(F.col("l_orderkey").cast("string")).alias("account_id"),
        F.when(tax == 0.08, F.date_format("l_shipdate", "yyyy/MM/dd")).when(tax == 0.07, "2026-02-30").otherwise(day).alias(
            "transaction_date"
        ),
        F.when(quantity == 50, "TRANSFER").when(F.col("l_linestatus") == "F", "CREDIT").otherwise("DEBIT").alias(
            "transaction_type"
        ),
        F.when(quantity == 2, "")
        .when(quantity == 3, F.concat(F.lit("-"), price))
        .when(quantity == 4, "0.00")
        .when(quantity == 5, "1e10")
        .otherwise(price)
        .alias("amount"),
        F.when(F.col("l_discount") == 0.1, "EUR").otherwise("USD").alias("currency"),
    )


def known_accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Reference accounts: orders that are not pending."""
    return (
        table(spark, folder, "orders")
        .filter(F.col("o_orderstatus") != "P")
        .select(F.col("o_orderkey").cast("string").alias("account_id"))
    )


KNOWN_SQL = "known AS (SELECT CAST(o_orderkey AS VARCHAR) AS account_id FROM orders WHERE o_orderstatus <> 'P')"
