"""Registered products: what is written is read back, several runs meet in one store, gates close."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.feed import FEED_SQL, feed, known_accounts
from ledgerloom.catalog.files import branch_landing, deliver
from ledgerloom.catalog.quality import dirty
from ledgerloom.catalog.reports import nation_customers
from ledgerloom.catalog.roles import dbl, frames, transactions
from ledgerloom.catalog.state import JUDGED_SQL
from ledgerloom.operators import quality as Q
from ledgerloom.operators.aggregates import grand_total
from ledgerloom.operators.transforms import typed_dates
from ledgerloom.plans import analytical
from ledgerloom.plans.customer_summary import customer_360
from ledgerloom.plans.delivery import check_delivery, publish_delivery
from ledgerloom.plans.medallion import Store, run_medallion
from ledgerloom.schemas import TRANSACTION_COLUMNS
from ledgerloom.session import materialize, scratch_path
from ledgerloom.sinks.publish import publish, read_current

CSV = {"header": True, "quote": '"', "escape": '"'}


def published(spark, folder) -> str:
    base = scratch_path(spark, "delivery")
    publish_delivery(check_delivery(spark, branch_landing(spark, folder)), base)
    return base


def three_runs(spark, folder) -> Store:
    """Files before 1998, the same folder again, then all files: the store after three runs."""
    store, known = Store(spark, scratch_path(spark, "runs")), materialize(known_accounts(spark, folder), "known")
    rows = feed(spark, folder)
    early = rows.filter(F.col("file_date") < F.lit("1998-01-01").cast("date"))
    first = deliver(early, "source_file", ["place"], TRANSACTION_COLUMNS)
    for landing in (first, first, branch_landing(spark, folder)):
        result = run_medallion(spark, landing, store.base, known)
        if result["status"] != "SUCCESS":
            raise RuntimeError(result["reason"])
    return store


def register(reg) -> None:
    def again(name: str, of: str, build) -> None:
        """A further way to the result of a query that is registered already."""
        reg.add(name, reg.oracles[of])(build)

    reg.add(
        "k_delivery_metrics",
        f"""WITH {FEED_SQL}, counted AS (SELECT *, COUNT(*) OVER (PARTITION BY transaction_id) AS copies FROM ruled),
        judged AS (SELECT *, value_reasons <> '' OR (copies > 1 AND transaction_id <> '') AS bad FROM counted)
        SELECT 'total_input_records' AS metric, CAST(COUNT(*) AS VARCHAR) AS "value" FROM judged
        UNION ALL SELECT 'valid_records', CAST(COUNT(*) FILTER (NOT bad) AS VARCHAR) FROM judged
        UNION ALL SELECT 'invalid_records', CAST(COUNT(*) FILTER (bad) AS VARCHAR) FROM judged
        UNION ALL SELECT 'records_from_' || source_file, CAST(COUNT(*) AS VARCHAR) FROM judged GROUP BY source_file""",
    )(
        lambda s, f: s.read.csv(f"{published(s, f)}/DQsummary.csv", **CSV).filter(
            F.col("metric").isin("total_input_records", "valid_records", "invalid_records") | F.startswith("metric", F.lit("records_from_"))
        )
    )
    reg.add(
        "k_valid_output",
        f"""WITH {FEED_SQL}, counted AS (SELECT *, COUNT(*) OVER (PARTITION BY transaction_id) AS copies FROM ruled)
        SELECT transaction_id, account_id, transaction_date, transaction_type, amount, currency, source_file
        FROM counted WHERE value_reasons = '' AND copies = 1""",
    )(lambda s, f: s.read.csv(f"{published(s, f)}/valid_transactions.csv", **CSV))

    def written_star(name: str):
        def build(s, f):
            base = scratch_path(s, "star")
            analytical.rebuild_star(frames(s, f), base)
            return analytical.report(name, analytical.load_star(s, base))

        return build

    again("star_written_by_branch", "aq1_by_branch", written_star("by_branch"))
    again("star_written_by_date", "aq5_by_date", written_star("by_date"))
    again("star_written_by_segment", "aq6_by_segment_and_branch", written_star("by_segment_and_branch"))

    def published_summary(s, f):
        base = scratch_path(s, "summary")
        gold = customer_360(*nation_customers(s, f))
        publish(gold, base, "v1", ["customer_id"], ["customer_id"])
        return read_current(s, base)

    again("customer_360_published", "customer_360", published_summary)

    reg.add(
        "p_typed_dates",
        "SELECT l_orderkey * 10 + l_linenumber AS transaction_id, year(l_shipdate) AS y, dayofyear(l_shipdate) AS d FROM lineitem",
    )(
        lambda s, f: typed_dates(transactions(s, f).withColumn("transaction_date", F.col("transaction_date").cast("string"))).select(
            "transaction_id", F.year("transaction_date").cast("long").alias("y"), F.dayofyear("transaction_date").cast("long").alias("d")
        )
    )

    def gate_result(s, f):
        """What the gate says about faulty tables: the number of failed checks."""
        try:
            Q.gate(Q.run_checks(*dirty(s, f)))
        except Q.DataQualityError as error:
            return s.range(1).select(F.lit(int(str(error).split(" ")[0])).cast("long").alias("failed_checks"))
        return s.range(1).select(F.lit(0).cast("long").alias("failed_checks"))

    checks = reg.oracles["dq_checks"]
    reg.add("dq_gate", f"SELECT COUNT(*) AS failed_checks FROM ({checks}) WHERE bad > 0")(gate_result)

    constrained = reg.oracles["dq_constraints"]
    reg.add("dq_constraints_accepted", f"SELECT transaction_id, account_id FROM ({constrained}) WHERE violations = ''")(
        lambda s, f: Q.split_by_constraints(
            Q.check_constraints(
                dirty(s, f)[0], "bank_transaction", "transaction_id", ["account_id", "amount"], {"account_id": dirty(s, f)[1]}, True
            )
        )[0].select("transaction_id", "account_id")
    )
    reg.add(
        "a_large_totals",
        "SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * 1000000000) AS DECIMAL(38,2))::VARCHAR AS total FROM lineitem",
    )(
        lambda s, f: grand_total(
            transactions(s, f).withColumn("amount", (F.col("amount") * 1000000000).cast("decimal(18,2)"))
        ).select(F.col("total_transaction_amount").cast("string").alias("total"))
    )

    # three runs over a growing folder: later repeats lose, earlier results stay, totals agree
    reg.add(
        "medallion_runs_gold",
        f"""WITH {JUDGED_SQL} SELECT branch_id, transaction_date, transaction_type, COUNT(*) AS transaction_count,
        {dbl('SUM(CAST(amount AS DECIMAL(18,2)))')} AS total_amount FROM judged WHERE reasons = '' GROUP BY ALL""",
    )(lambda s, f: three_runs(s, f).gold().drop("published_run_id"))
    reg.add(
        "medallion_runs_status",
        f"""WITH {FEED_SQL}, n AS (SELECT COUNT(DISTINCT source_file) AS everything,
            COUNT(DISTINCT source_file) FILTER (file_date < DATE '1998-01-01') AS early FROM feed)
        SELECT 'LOADED or PROCESSED' AS state, everything AS files FROM n
        UNION ALL SELECT 'SKIPPED_IDENTICAL', early * 2 FROM n""",
    )(
        lambda s, f: three_runs(s, f)
        .file_audit()
        .groupBy(F.when(F.col("file_status") == "SKIPPED_IDENTICAL", F.col("file_status")).otherwise("LOADED or PROCESSED").alias("state"))
        .agg(F.count("*").alias("files"))
    )
    reg.add(
        "medallion_bronze",
        f"""WITH {FEED_SQL}, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_file ORDER BY place) AS row_number FROM feed)
        SELECT source_file AS source_filename, branch_id, row_number AS source_row_number, transaction_id, account_id,
        transaction_date, transaction_type, amount, currency FROM n""",
    )(
        lambda s, f: three_runs(s, f).bronze().select("source_filename", "branch_id", "source_row_number", *TRANSACTION_COLUMNS)
    )
