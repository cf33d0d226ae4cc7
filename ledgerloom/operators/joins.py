"""Join operators.

Nothing here forces a broadcast of a table that can grow: Catalyst broadcasts a side whose size
it knows to be below ``spark.sql.autoBroadcastJoinThreshold`` and AQE does so at run time; any
larger side is joined by shuffle, where AQE splits hot keys. To keep that split possible the
many-side is always on the left and the right side holds one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize


def enrich_accounts(accounts: DataFrame, customers: DataFrame, branches: DataFrame) -> DataFrame:
    """Join the reference tables among themselves first: they are far smaller than the facts."""
    return accounts.join(customers, "customer_id").join(branches, "branch_id")


def detail(tx: DataFrame, accounts: DataFrame, customers: DataFrame, branches: DataFrame) -> DataFrame:
    """Every transaction with account, customer and branch; unmatched rows drop out.

    The facts are shuffled at most once, on account_id.
    """
    return tx.join(enrich_accounts(accounts, customers, branches), "account_id")


def unmatched(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-null key has no parent row."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def unmatched_rows(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Number of such rows (column ``bad``), counting per key before the join so no key is hot."""
    per_key = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return per_key.join(parent.select(key), key, "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("bad")
    )


def matched_rows(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Number of child rows with a parent (column ``links``)."""
    per_key = child.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.join(parent.select(key), key, "left_semi").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("links")
    )


def with_member_flag(df: DataFrame, members: DataFrame, key: str, flag: str, unique: bool = False) -> DataFrame:
    """Add boolean ``flag``: is the row's key among the ``members`` keys?

    A NULL key is no member. ``unique`` says the member keys are known to be distinct.
    """
    keys = members.select(F.col(key).alias("__member")).filter(F.col("__member").isNotNull())
    if not unique:
        keys = keys.distinct()
    return (
        df.join(keys, F.col(key) == F.col("__member"), "left")
        .withColumn(flag, F.col("__member").isNotNull())
        .drop("__member")
    )


def with_unknown_flag(
    df: DataFrame, members: DataFrame, key: str, flag: str, keys_from: DataFrame | None = None
) -> DataFrame:
    """Add boolean ``flag``: does the row's non-null key lack a member?

    Made for a large member table that almost every row matches. The keys in use collapse to
    distinct values before they meet the members, and the unmatched ones are written down: their
    true size then decides whether they are broadcast, and the rows themselves need no shuffle.
    ``keys_from`` has the same keys as ``df`` or more and is cheaper to read, by default ``df`` itself.
    """
    used = (df if keys_from is None else keys_from).select(F.col(key).alias("__unknown")).filter(F.col(key).isNotNull()).distinct()
    known = members.select(F.col(key).alias("__unknown"))
    unknown = materialize(used.join(known, "__unknown", "left_anti"), "unknown")
    return (
        df.join(unknown, F.col(key) == F.col("__unknown"), "left")
        .withColumn(flag, F.col("__unknown").isNotNull())
        .drop("__unknown")
    )


def lookup(df: DataFrame, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """Add ``value`` from ``mapping`` (one row per key); NULL where the key is unknown."""
    return df.join(mapping.select(key, value), key, "left")


def dimension_orphans(fact: DataFrame, dimensions: dict[str, DataFrame]) -> DataFrame:
    """Fact rows that miss a parent, per dimension key: (dimension_key, bad)."""
    parts = [
        unmatched_rows(fact, dim, key).select(F.lit(key).alias("dimension_key"), "bad")
        for key, dim in dimensions.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def relationship_links(
    tx: DataFrame, accounts: DataFrame, customers: DataFrame, branches: DataFrame
) -> DataFrame:
    """How many child rows resolve over each foreign key: (relationship, links)."""
    parts = [
        ("customer_account_links", matched_rows(accounts, customers, "customer_id")),
        ("branch_account_links", matched_rows(accounts, branches, "branch_id")),
        ("account_transaction_links", matched_rows(tx, accounts, "account_id")),
    ]
    named = [df.select(F.lit(name).alias("relationship"), "links") for name, df in parts]
    return named[0].unionByName(named[1]).unionByName(named[2])
