"""Tables, reference files and generated rows as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ledgerloom.functions.money import CURRENCY, money
from ledgerloom.functions.text import strip
from ledgerloom.operators.ordered import running_sum
from ledgerloom.schemas import BRANCH, ACCOUNT, BANK_TRANSACTION, CUSTOMER


def load_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Parquet table ``name`` below ``base``, pruned and filtered at the scan."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}")


def load_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV columns picked by header name and typed as ``schema`` says; bad values become NULL."""
    text = spark.read.csv(path, header=True, quote='"', escape='"')
    return text.select(
        *[
            (F.col(f.name) if isinstance(f.dataType, StringType) else F.col(f.name).try_cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def load_operational(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The four operational tables from CSV, keyed customer, branch, account, bank_transaction."""
    schemas = {"customer": CUSTOMER, "branch": BRANCH, "account": ACCOUNT, "bank_transaction": BANK_TRANSACTION}
    return {name: load_csv(spark, paths[name], schemas[name]) for name in schemas if name in paths}


def load_typed_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV in exactly the column order of ``schema``, parsed to its types by the scan."""
    return spark.read.csv(path, header=True, schema=schema)


def account_ids(accounts: DataFrame) -> DataFrame:
    """Distinct stripped account ids of a reference table."""
    return accounts.select(strip(F.col("account_id")).alias("account_id")).distinct()


def register_views(frames: dict[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def synthetic_transactions(
    accounts: DataFrame, rows: int, seed: int = 42, first_day: str = "2026-01-01", days: int = 273
) -> DataFrame:
    """``rows`` generated transactions spread evenly over the accounts.

    Dates are uniform, types 55/45, amounts log-normal between 1 and 5000. Every value is a hash
    of the row number and the seed, so a retried task yields the same rows.
    """
    spark = accounts.sparkSession
    known = accounts.select("account_id").distinct()
    slots = known.count()
    if slots == 0:
        raise ValueError("no accounts to generate transactions for")

    def uniform(salt: int):
        return (F.pmod(F.xxhash64(F.col("i"), F.lit(seed), F.lit(salt)), F.lit(1 << 53)) + 0.5) / float(1 << 53)

    gauss = F.sqrt(-2 * F.log(uniform(3))) * F.cos(2 * 3.141592653589793 * uniform(4))
    amount = F.greatest(F.least(F.exp(4.5 + gauss), F.lit(5000.0)), F.lit(1.0))
    facts = spark.range(1, rows + 1).withColumnRenamed("id", "i").select(
        "i",
        F.floor(uniform(1) * slots).alias("slot"),
        F.date_add(F.lit(first_day).cast("date"), F.floor(uniform(2) * days).cast("int")).alias("transaction_date"),
        F.when(uniform(5) < 0.55, "CREDIT").otherwise("DEBIT").alias("transaction_type"),
        money(F.round(amount, 2)).alias("amount"),
    )
    numbered = running_sum(known.withColumn("one", F.lit(1).cast("long")), ["account_id"], "one", "slot", inclusive=False)
    return facts.join(numbered.select("account_id", "slot"), "slot").select(
        F.format_string("G%06d", "i").alias("transaction_id"),
        "account_id",
        "transaction_date",
        "transaction_type",
        "amount",
        F.lit(CURRENCY).alias("currency"),
    )
