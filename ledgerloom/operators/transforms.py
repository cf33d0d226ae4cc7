"""Row-wise operators: projections, filters and derived columns. None of them shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import date_key, day_name, strict_date
from ledgerloom.functions.money import (
    CREDIT,
    amount_band,
    flow_amount,
    parse_money,
    signed_amount,
)
from ledgerloom.functions.text import clean_upper, strip
from ledgerloom.schemas import MONEY

HIGH_VALUE = "500.00"
REPORTING_COLUMNS = ["transaction_id", "account_id", "transaction_date", "transaction_type", "amount"]


def reporting_columns(df: DataFrame) -> DataFrame:
    return df.select(*REPORTING_COLUMNS)


def typed_dates(df: DataFrame, column: str = "transaction_date") -> DataFrame:
    """ISO text to DATE; text that is no date becomes NULL."""
    return df.withColumn(column, strict_date(F.col(column)))


def credits_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("transaction_type") == CREDIT)


def of_types(df: DataFrame, kinds: list[str]) -> DataFrame:
    return df.filter(F.col("transaction_type").isin(kinds))


def high_value(df: DataFrame, threshold=HIGH_VALUE) -> DataFrame:
    """Rows at or above ``threshold``; the bare column keeps the predicate pushable."""
    return df.filter(F.col("amount") >= F.lit(str(threshold)).cast(MONEY))


def with_signed_amount(df: DataFrame) -> DataFrame:
    return df.withColumn("signed_amount", signed_amount(F.col("transaction_type"), F.col("amount")))


def with_flow_amount(df: DataFrame) -> DataFrame:
    return df.withColumn("signed_amount", flow_amount(F.col("transaction_type"), F.col("amount")))


def with_amount_band(df: DataFrame) -> DataFrame:
    return df.withColumn("amount_band", amount_band(F.col("amount")))


def missing_values(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def non_positive(df: DataFrame, column: str) -> DataFrame:
    """Values at or below zero; NULLs are not counted here."""
    return df.filter(F.col(column) <= 0)


def with_date_parts(df: DataFrame, column: str) -> DataFrame:
    day = F.col(column)
    return df.select(
        date_key(day).alias("date_key"),
        day.alias("full_date"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("day"),
        day_name(day).alias("day_name"),
    )


def cleansed(df: DataFrame, **kinds: str) -> DataFrame:
    """Staging clean-up: one output column per keyword, in keyword order.

    Kinds: ``key`` (text as is), ``text`` (stripped), ``code`` (stripped, upper case), ``date``, ``money``.
    """
    makers = {
        "key": lambda c: c.cast("string"),
        "text": lambda c: strip(c.cast("string")),
        "code": lambda c: clean_upper(c.cast("string")),
        "date": lambda c: c.cast("date"),
        "money": lambda c: c.cast(MONEY),
    }
    return df.select(*[makers[kind](F.col(name)).alias(name) for name, kind in kinds.items()])


def typed_silver(df: DataFrame) -> DataFrame:
    """Accepted text rows as typed rows; the other columns stay."""
    return df.withColumns(
        {
            "transaction_date": strict_date(F.col("transaction_date")),
            "amount": parse_money(F.col("amount")),
        }
    )


def with_run_lineage(df: DataFrame, run_id: str, loaded_at: Column) -> DataFrame:
    """Stamp rows with the run that loaded them."""
    return df.withColumns({"run_id": F.lit(run_id), "load_timestamp": loaded_at})


def at_edge(df: DataFrame) -> DataFrame:
    """Result columns of a registered query: decimals as DOUBLE, dates as ISO text, order unchanged."""
    shown = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        col = F.col(f"`{field.name}`")
        if kind == "decimal":
            col = col.cast("double")
        elif kind == "date":
            col = col.cast("string")
        shown.append(col.alias(field.name))
    return df.select(*shown)
