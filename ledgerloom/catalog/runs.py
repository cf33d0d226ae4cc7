"""Registered runs: commits, stored upserts, the id index, failures and their texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.feed import FEED_SQL, feed, known_accounts
from ledgerloom.catalog.files import branch_landing, deliver
from ledgerloom.catalog.quality import VALIDATED_SQL, validated
from ledgerloom.catalog.roles import accounts, dbl, frames, table, transactions, with_roles
from ledgerloom.catalog.state import JUDGED_SQL, daily_batch, solvent_suppliers, stored_table
from ledgerloom.operators import ordered as O
from ledgerloom.operators import quality as Q
from ledgerloom.operators.aggregates import by_branch
from ledgerloom.plans import analytical
from ledgerloom.plans.medallion import Store, run_medallion
from ledgerloom.schemas import TRANSACTION_COLUMNS
from ledgerloom.session import materialize, scratch_path
from ledgerloom.sinks.audit import utc_text
from ledgerloom.sinks.together import publish_together
from ledgerloom.streaming import upsert
from ledgerloom.streaming.id_index import IdIndex
from ledgerloom.streaming.keyed_table import KeyedTable

EARLY = "DATE '1998-01-01'"


def keyed_upsert(spark, folder):
    """The daily batch brought into a stored table: only its own buckets are rewritten."""
    stored = stored_table(spark, folder)
    home = KeyedTable(spark, scratch_path(spark, "keyed"), "transaction_id", stored.schema)
    home.upsert(stored)
    upsert.upsert_batch(home, daily_batch(spark, folder), solvent_suppliers(spark, folder))
    return home.read()


def ids_seen(spark, folder):
    """Order ids accepted by three runs, the last one without a commit, asked for by all line items."""
    index = IdIndex(spark, scratch_path(spark, "index"))
    orders = table(spark, folder, "orders").select(F.concat(F.lit("T"), "o_orderkey").alias("id"), F.year("o_orderdate").alias("y"))
    for run, rows in (("A", "y < 1995"), ("B", "y BETWEEN 1995 AND 1996"), ("C", "y > 1996")):
        index.add(run, orders.filter(rows).select("id"))
    batch = table(spark, folder, "lineitem").select(F.concat(F.lit("T"), "l_orderkey").alias("id"))
    return index.seen(batch, spark.createDataFrame([("A",), ("B",)], "run_id string"))


def early_rows(spark, folder):
    return feed(spark, folder).filter(F.col("file_date") < F.lit("1998-01-01").cast("date"))


def run_reasons(spark, folder):
    """What three runs over a growing folder say of themselves."""
    base, known = scratch_path(spark, "runs"), materialize(known_accounts(spark, folder), "known")
    first = deliver(early_rows(spark, folder), "source_file", ["place"], TRANSACTION_COLUMNS)
    results = [run_medallion(spark, landing, base, known) for landing in (first, first, branch_landing(spark, folder))]
    return spark.createDataFrame([(i + 1, r["status"], r["reason"]) for i, r in enumerate(results)], "run int, status string, reason string")


def gold_after_failure(spark, folder):
    """Gold after a run whose late files lack a column: it fails at ingest and changes nothing."""
    store, known = Store(spark, scratch_path(spark, "failed")), materialize(known_accounts(spark, folder), "known")
    early = deliver(early_rows(spark, folder), "source_file", ["place"], TRANSACTION_COLUMNS)
    late = feed(spark, folder).filter(F.col("file_date") >= F.lit("1998-01-01").cast("date"))
    short = deliver(late, "source_file", ["place"], TRANSACTION_COLUMNS[:-1])
    results = [run_medallion(spark, landing, store.base, known) for landing in (early, short)]
    statuses = ", ".join(r["status"] for r in results)
    step = results[1]["reason"].split(":")[0]
    return store.gold().drop("published_run_id").withColumns({"statuses": F.lit(statuses), "step": F.lit(step)})


def star_after_failure(spark, folder):
    """The star that readers see after a build that failed between two tables."""
    base, star = scratch_path(spark, "star"), analytical.build_star(frames(spark, folder))
    publish_together(star.tables(), base)
    broken = star.tables()
    broken["dim_date"] = broken["dim_date"].withColumn("day_name", F.raise_error(F.lit("stop")).cast("string"))
    broken["dim_customer"] = broken["dim_customer"].limit(0)
    try:
        publish_together(broken, base)
    except Exception as error:
        if "stop" not in str(error):
            raise
    return analytical.report("by_branch", analytical.load_star(spark, base))


def grain_message(spark, folder):
    try:
        Q.assert_grain(table(spark, folder, "lineitem"), "l_orderkey")
        message = ""
    except ValueError as error:
        message = str(error)
    return spark.createDataFrame([(message,)], "message string")


def in_order(df):
    """A short ordered result with the position of each row as it arrives."""
    rows = [(i + 1, *r) for i, r in enumerate(df.collect())]
    return df.sparkSession.createDataFrame(rows, "position int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields))


def register(reg) -> None:
    reg.add("m_keyed_upsert_table", reg.oracles["m_upsert_table"])(keyed_upsert)
    reg.add(
        "m_ids_seen_before",
        "SELECT DISTINCT 'T' || l_orderkey AS id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE year(o_orderdate) < 1997",
    )(ids_seen)
    reg.add(
        "medallion_runs_summary",
        f"""WITH {JUDGED_SQL},
        f AS (SELECT COUNT(DISTINCT source_file) AS files, COUNT(DISTINCT source_file) FILTER (file_date < {EARLY}) AS early,
            COUNT(*) FILTER (reasons = '' AND file_date < {EARLY}) AS a1, COUNT(*) FILTER (reasons <> '' AND file_date < {EARLY}) AS r1,
            COUNT(*) FILTER (reasons = '' AND file_date >= {EARLY}) AS a3, COUNT(*) FILTER (reasons <> '' AND file_date >= {EARLY}) AS r3,
            COUNT(DISTINCT (branch_id, transaction_date, transaction_type)) FILTER (reasons = '' AND file_date < {EARLY}) AS g1,
            COUNT(DISTINCT (branch_id, transaction_date, transaction_type)) FILTER (reasons = '') AS g3 FROM judged)
        SELECT 1 AS run, 'SUCCESS' AS status, 'files loaded=' || early || ', skipped_identical=0, unrecognized=0; accepted=' || a1 || ', rejected=' || r1
            || '; gold_rows=' || g1 AS reason FROM f
        UNION ALL SELECT 2, 'SUCCESS', 'files loaded=0, skipped_identical=' || early || ', unrecognized=0; accepted=0, rejected=0; gold_rows=' || g1 FROM f
        UNION ALL SELECT 3, 'SUCCESS', 'files loaded=' || (files - early) || ', skipped_identical=' || early || ', unrecognized=0; accepted=' || a3
            || ', rejected=' || r3 || '; gold_rows=' || g3 FROM f""",
    )(run_reasons)
    reg.add(
        "medallion_failed_run",
        f"""WITH {JUDGED_SQL} SELECT branch_id, transaction_date, transaction_type, COUNT(*) AS transaction_count,
        {dbl('SUM(CAST(amount AS DECIMAL(18,2)))')} AS total_amount, 'SUCCESS, FAILED' AS statuses, 'ingest failed' AS step
        FROM judged WHERE reasons = '' AND file_date < {EARLY} GROUP BY branch_id, transaction_date, transaction_type""",
    )(gold_after_failure)
    reg.add("star_after_failure", reg.oracles["aq1_by_branch"])(star_after_failure)
    reg.add(
        "dq_grain_message",
        "SELECT 'grain check failed: rows=' || COUNT(*) || ', distinct l_orderkey=' || COUNT(DISTINCT l_orderkey) AS message FROM lineitem",
    )(grain_message)
    reg.add("f_utc_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM events")(
        lambda s, f: table(s, f, "events").select("event_id", utc_text(F.col("ts")).alias("utc"))
    )
    reg.add(
        "o_newest_orders_in_order",
        """SELECT CAST(ROW_NUMBER() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS position, o_orderkey FROM orders
        ORDER BY position LIMIT 20""",
    )(lambda s, f: in_order(O.newest(table(s, f, "orders"), ["o_orderdate", "o_orderkey"], 20).select("o_orderkey")))
    reg.add(
        "dq_unreconciled_files",
        f"""WITH {VALIDATED_SQL}, n AS (SELECT source_file AS source_filename, COUNT(*) AS bronze_rows,
            COUNT(*) + CASE WHEN source_file LIKE 'BR001%' THEN 1 ELSE 0 END AS source_rows,
            COUNT(*) FILTER (error_reason = '') AS accepted_rows, COUNT(*) FILTER (error_reason <> '') AS rejected_rows
            FROM validated GROUP BY source_file)
        SELECT source_filename, source_rows, bronze_rows, accepted_rows, rejected_rows, source_rows = bronze_rows AS reconciled FROM n""",
    )(
        lambda s, f: Q.reconcile_files(
            feed(s, f)
            .groupBy(F.col("source_file").alias("source_filename"))
            .agg((F.count("*") + F.when(F.col("source_filename").startswith("BR001"), 1).otherwise(0)).alias("source_rows")),
            validated(s, f).withColumnRenamed("source_file", "source_filename"),
        )
    )
    reg.add(
        "dq_join_incomplete",
        with_roles(
            """SELECT (SELECT COUNT(*) FROM tx) AS input_rows, COUNT(*) AS summary_rows, COUNT(*) = (SELECT COUNT(*) FROM tx) AS complete
            FROM tx JOIN orders ON tx.account_id = o_orderkey AND o_orderkey > 1000"""
        ),
    )(lambda s, f: Q.join_completeness(transactions(s, f), by_branch(transactions(s, f), accounts(s, f).filter("account_id > 1000"))))
    reg.add(
        "dq_totals_disagree",
        with_roles(
            f"""SELECT {dbl('SUM(amount)')} AS left_total, {dbl("SUM(CASE WHEN transaction_type = 'CREDIT' THEN amount END)")} AS right_total,
            SUM(amount) = SUM(CASE WHEN transaction_type = 'CREDIT' THEN amount END) AS agree FROM tx"""
        ),
    )(lambda s, f: Q.totals_agree(transactions(s, f), "amount", transactions(s, f).filter("transaction_type = 'CREDIT'"), "amount"))
