"""Registered single operators: projections, filters, joins, aggregates, windows, functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.reports import CREDITS, NET, raw_layers
from ledgerloom.catalog.roles import (
    accounts,
    branches,
    customers,
    dbl,
    frames,
    mean_sql,
    payments,
    table,
    transactions,
    with_roles,
)
from ledgerloom.functions import dates, money, text
from ledgerloom.operators import aggregates as A
from ledgerloom.operators import joins as J
from ledgerloom.operators import ordered as O
from ledgerloom.operators import sets as U
from ledgerloom.operators import transforms as P
from ledgerloom.sources.tables import account_ids, synthetic_transactions

DATE = "CAST(transaction_date AS VARCHAR) AS transaction_date"
AMOUNT = f"{dbl('amount')} AS amount"
ROW = f"transaction_id, account_id, {DATE}, transaction_type, {AMOUNT}"

# order lines as text in the shapes people type: padded and unpadded ISO, American, slashes, blanks
UNTIDY = """untidy AS (
    SELECT o_orderkey AS k, o_orderdate AS d,
        CASE o_orderpriority
            WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d')
            WHEN '2-HIGH' THEN year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate)
            WHEN '3-MEDIUM' THEN month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate)
            WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y/%m/%d')
            ELSE '  ' END AS date_text,
        CASE o_orderpriority
            WHEN '1-URGENT' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
            WHEN '2-HIGH' THEN '-' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
            WHEN '3-MEDIUM' THEN CASE WHEN o_orderkey % 3 = 0 THEN repeat('7', CAST(17 + o_orderkey % 14 AS INT)) ELSE '' END
                || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
            WHEN '4-NOT SPECIFIED' THEN '0.00'
            ELSE '1e' || day(o_orderdate) END AS amount_text
    FROM orders)"""


def untidy(spark, folder):
    day, price = F.col("o_orderdate"), F.col("o_totalprice")
    parts = [F.year(day).cast("string"), F.month(day).cast("string"), F.dayofmonth(day).cast("string")]
    exact = money.money(price).cast("string")
    # amounts of 20 to 36 whole digits among the others
    lead = F.expr("repeat('7', CAST(17 + o_orderkey % 14 AS INT))")
    whole = F.concat(F.when(F.col("o_orderkey") % 3 == 0, lead).otherwise(""), F.floor(price).cast("string"))

    def pick(*values):
        """One value per priority, in priority order; the last one is the default."""
        chosen = F.when(F.col("o_orderpriority") == "1-URGENT", values[0])
        for name, value in zip(["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], values[1:4]):
            chosen = chosen.when(F.col("o_orderpriority") == name, value)
        return chosen.otherwise(values[4])

    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"),
        pick(
            F.date_format(day, "yyyy-MM-dd"),
            F.concat_ws("-", *parts),
            F.concat_ws("/", parts[1], parts[2], parts[0]),
            F.date_format(day, "yyyy/MM/dd"),
            F.lit("  "),
        ).alias("date_text"),
        pick(
            exact,
            F.concat(F.lit("-"), exact),
            whole,
            F.lit("0.00"),
            F.concat(F.lit("1e"), parts[2]),
        ).alias("amount_text"),
    )


def register(reg) -> None:
    # projections and filters
    reg.add("p_reporting_columns", with_roles(f"SELECT {ROW} FROM tx"))(
        lambda s, f: P.reporting_columns(transactions(s, f))
    )
    reg.add("p_credits_only", with_roles(f"SELECT {ROW} FROM tx WHERE transaction_type = 'CREDIT'"))(
        lambda s, f: P.reporting_columns(P.credits_only(transactions(s, f)))
    )
    reg.add("p_high_value", with_roles(f"SELECT {ROW} FROM tx WHERE amount >= 50000"))(
        lambda s, f: P.reporting_columns(P.high_value(transactions(s, f), "50000.00"))
    )
    reg.add(
        "p_signed_amount",
        with_roles(
            f"SELECT {ROW}, {dbl('''CASE WHEN transaction_type = 'CREDIT' THEN amount ELSE -amount END''')} "
            "AS signed_amount FROM tx"
        ),
    )(lambda s, f: P.with_signed_amount(P.reporting_columns(transactions(s, f))))
    reg.add(
        "p_flow_amount",
        f"""SELECT event_id, event_type, {dbl('''CASE WHEN event_type IN ('view', 'click') THEN -CAST(value AS
        DECIMAL(18,2)) WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END''')} AS signed_amount
        FROM events""",
    )(
        lambda s, f: P.with_flow_amount(
            table(s, f, "events").select(
                "event_id",
                "event_type",
                F.when(F.col("event_type") == "purchase", "DEPOSIT")
                .when(F.col("event_type") == "view", "PURCHASE")
                .when(F.col("event_type") == "click", "WITHDRAWAL")
                .otherwise("OTHER")
                .alias("transaction_type"),
                money.money(F.col("value")).alias("amount"),
            )
        ).select("event_id", "event_type", "signed_amount")
    )
    reg.add(
        "p_type_membership", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')"
    )(
        lambda s, f: P.of_types(
            table(s, f, "events").withColumnRenamed("event_type", "transaction_type"), ["click", "purchase"]
        ).select("event_id", F.col("transaction_type").alias("event_type"))
    )
    reg.add("p_non_positive_balances", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal <= 0")(
        lambda s, f: P.non_positive(table(s, f, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")
    )
    reg.add(
        "p_conditional_sums",
        with_roles(f"SELECT account_id, {dbl(CREDITS)} AS total_credits, {dbl(NET)} AS net_cash_flow FROM tx GROUP BY account_id"),
    )(lambda s, f: A.per_account(transactions(s, f), ["total_credits", "net_cash_flow"]))
    reg.add(
        "p_missing_sums",
        with_roles("SELECT a.account_id FROM account a LEFT JOIN tx t ON a.account_id = t.account_id "
                   "GROUP BY a.account_id HAVING SUM(t.amount) IS NULL"),
    )(
        lambda s, f: P.missing_values(
            accounts(s, f).select("account_id").join(
                A.per_account(transactions(s, f), ["gross_amount"]), "account_id", "left"
            ),
            "gross_amount",
        ).select("account_id")
    )

    # functions
    reg.add(
        "f_dates",
        f"""WITH {UNTIDY} SELECT k, date_text,
        CASE WHEN regexp_matches(date_text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN strftime(d, '%Y-%m-%d') END AS strict,
        CASE WHEN regexp_matches(date_text, '^[0-9]+-[0-9]+-[0-9]+$') OR regexp_matches(date_text, '^[0-9]+/[0-9]+/[0-9]{{4}}$')
             THEN strftime(d, '%Y-%m-%d') END AS flexible
        FROM untidy""",
    )(
        lambda s, f: untidy(s, f).select(
            "k", "date_text",
            dates.strict_date(F.col("date_text")).alias("strict"),
            dates.flexible_date(text.strip(F.col("date_text"))).alias("flexible"),
        )
    )
    reg.add(
        "f_amounts",
        f"""WITH {UNTIDY} SELECT k, amount_text,
        regexp_matches(amount_text, '^[0-9]+([.][0-9]+)?$') AND TRY_CAST(amount_text AS DOUBLE) > 0 AS accepted,
        {dbl('TRY_CAST(amount_text AS DECIMAL(18,2))')} AS parsed, length(amount_text) > 18 AND amount_text LIKE '7%' AS beyond FROM untidy
        """,
    )(
        lambda s, f: untidy(s, f).select(
            "k", "amount_text",
            money.is_plain_positive(F.col("amount_text")).alias("accepted"),
            money.parse_money(F.col("amount_text")).alias("parsed"),
            money.is_beyond_money(F.col("amount_text")).alias("beyond"),
        )
    )
    reg.add(
        "f_missing_text",
        f"WITH {UNTIDY} SELECT k, trim(date_text) = '' AS missing, nullif(trim(date_text), '') AS kept FROM untidy",
    )(
        lambda s, f: untidy(s, f).select(
            "k", text.is_missing(F.col("date_text")).alias("missing"),
            text.empty_to_null(text.strip(F.col("date_text"))).alias("kept"),
        )
    )
    reg.add(
        "f_date_parts",
        with_roles(
            """SELECT DISTINCT CAST(strftime(transaction_date, '%Y%m%d') AS INTEGER) AS date_key,
            CAST(transaction_date AS VARCHAR) AS full_date, CAST(year(transaction_date) AS INTEGER) AS year,
            CAST(month(transaction_date) AS INTEGER) AS month, CAST(day(transaction_date) AS INTEGER) AS day,
            dayname(transaction_date) AS day_name FROM pay"""
        ),
    )(lambda s, f: P.with_date_parts(A.distinct_values(payments(s, f), "transaction_date"), "transaction_date"))
    reg.add(
        "f_json_record",
        """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || ',"note":null}' AS raw_record
        FROM nation""",
    )(
        lambda s, f: table(s, f, "nation")
        .withColumn("note", F.lit(None).cast("string"))
        .select("n_nationkey", text.json_record(["note", "n_regionkey", "n_name"]).alias("raw_record"))
    )
    reg.add("f_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")(
        lambda s, f: table(s, f, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    )
    reg.add(
        "f_reason_text",
        "SELECT o_orderkey, o_orderstatus || '; ' || o_orderpriority AS reasons FROM orders",
    )(
        lambda s, f: table(s, f, "orders").select(
            "o_orderkey",
            text.join_reasons(
                text.normalize_reasons(
                    F.concat("o_orderstatus", F.lit(" ; ;"), "o_orderpriority", F.lit(";")), "rejected"
                )
            ).alias("reasons"),
        )
    )
    reg.add(
        "f_shares",
        f"""SELECT o_custkey, {mean_sql('SUM(CAST(o_totalprice AS DECIMAL(18,2)))', 'COUNT(*)')} AS mean_price,
        CAST((20000 * COUNT(*) FILTER (o_orderstatus = 'F') + COUNT(*)) // (2 * COUNT(*)) AS DOUBLE) / 100 AS percent_f
        FROM orders GROUP BY o_custkey""",
    )(
        lambda s, f: table(s, f, "orders")
        .groupBy("o_custkey")
        .agg(
            F.sum(money.money(F.col("o_totalprice"))).alias("total"),
            F.count("*").alias("n"),
            F.count_if(F.col("o_orderstatus") == "F").alias("nf"),
        )
        .select(
            "o_custkey",
            money.mean_money(F.col("total"), F.col("n")).alias("mean_price"),
            money.percent_of(F.col("nf").cast("decimal(20,2)"), F.col("n").cast("decimal(20,2)")).alias("percent_f"),
        )
    )

    # joins
    reg.add(
        "j_detail",
        with_roles(
            f"""SELECT t.transaction_id, t.account_id, {dbl('t.amount')} AS amount, c.customer_name, b.branch_name
            FROM tx t JOIN account a ON t.account_id = a.account_id JOIN cust c ON a.customer_id = c.customer_id
            JOIN branch b ON a.branch_id = b.branch_id"""
        ),
    )(
        lambda s, f: J.detail(
            transactions(s, f), accounts(s, f), customers(s, f), branches(s, f)
        ).select("transaction_id", "account_id", "amount", "customer_name", "branch_name")
    )
    reg.add(
        "j_unmatched",
        with_roles(
            """SELECT t.transaction_id, t.account_id FROM tx t WHERE NOT EXISTS
            (SELECT 1 FROM account a WHERE a.account_id = t.account_id AND a.account_status <> 'P')"""
        ),
    )(
        lambda s, f: J.unmatched(
            transactions(s, f), accounts(s, f).filter(F.col("account_status") != "P"), "account_id"
        ).select("transaction_id", "account_id")
    )
    reg.add(
        "j_relationship_links",
        with_roles(
            """SELECT 'customer_account_links' AS relationship, COUNT(*) AS links FROM account JOIN cust USING (customer_id)
            UNION ALL SELECT 'branch_account_links', COUNT(*) FROM account JOIN branch USING (branch_id)
            UNION ALL SELECT 'account_transaction_links', COUNT(*) FROM tx JOIN account USING (account_id)"""
        ),
    )(lambda s, f: J.relationship_links(*vars(frames(s, f)).values()))
    reg.add(
        "j_member_flag",
        with_roles(
            """SELECT account_id, COALESCE(account_id IN (SELECT account_id FROM tx WHERE transaction_type = 'CREDIT'), false)
            AS has_credit FROM account"""
        ),
    )(
        lambda s, f: J.with_member_flag(
            accounts(s, f).select("account_id"), P.credits_only(transactions(s, f)), "account_id", "has_credit"
        )
    )
    reg.add(
        "j_lookup",
        with_roles(
            """SELECT t.transaction_id, t.account_id, a.customer_id FROM tx t LEFT JOIN
            (SELECT * FROM account WHERE account_status <> 'P') a ON t.account_id = a.account_id"""
        ),
    )(
        lambda s, f: J.lookup(
            transactions(s, f).select("transaction_id", "account_id"),
            accounts(s, f).filter(F.col("account_status") != "P"),
            "account_id", "customer_id",
        ).select("transaction_id", "account_id", "customer_id")
    )
    reg.add(
        "j_dimension_orphans",
        with_roles(
            """SELECT 'account_id' AS dimension_key, COUNT(*) AS bad FROM tx WHERE account_id NOT IN
            (SELECT account_id FROM account WHERE account_status = 'F')
            UNION ALL SELECT 'transaction_type', 0"""
        ),
    )(
        lambda s, f: J.dimension_orphans(
            transactions(s, f),
            {
                "account_id": accounts(s, f).filter(F.col("account_status") == "F"),
                "transaction_type": transactions(s, f).select("transaction_type").distinct(),
            },
        )
    )

    # aggregates
    reg.add(
        "a_by_type",
        with_roles(
            f"""SELECT transaction_type, COUNT(*) AS transaction_count, {dbl('SUM(amount)')} AS total_amount,
            {mean_sql('SUM(amount)', 'COUNT(*)')} AS avg_amount FROM tx GROUP BY transaction_type"""
        ),
    )(lambda s, f: A.by_type(transactions(s, f)))
    basic = f"COUNT(*) AS transaction_count, {dbl('SUM(amount)')} AS gross_amount, {dbl(NET)} AS net_cash_flow"
    reg.add("a_by_account", with_roles(f"SELECT account_id, {basic} FROM tx GROUP BY account_id"))(
        lambda s, f: A.by_account(transactions(s, f))
    )
    joined = (
        "FROM tx t JOIN account a ON t.account_id = a.account_id JOIN cust c ON a.customer_id = c.customer_id "
        "JOIN branch b ON a.branch_id = b.branch_id"
    )
    for name, keys in {
        "a_activity_by_customer": ["customer_id", "customer_name", "customer_segment"],
        "a_activity_by_branch": ["branch_id", "branch_name", "city"],
        "a_activity_by_account_type": ["account_type"],
        "a_activity_by_segment_and_state": ["customer_segment", "state"],
    }.items():
        cols = ", ".join({"customer_id": "a.customer_id", "branch_id": "a.branch_id"}.get(k, k) for k in keys)
        reg.add(name, with_roles(f"SELECT {cols}, {basic} {joined} GROUP BY {cols}"))(
            lambda s, f, keys=keys: A.activity_by(
                transactions(s, f), accounts(s, f), keys, customers=customers(s, f), branches=branches(s, f)
            )
        )
    reg.add(
        "a_row_counts",
        """SELECT 'lineitem' AS table_name, COUNT(*) AS row_count FROM lineitem
        UNION ALL SELECT 'orders', COUNT(*) FROM orders UNION ALL SELECT 'customer', COUNT(*) FROM customer
        UNION ALL SELECT 'nation', COUNT(*) FROM nation""",
    )(lambda s, f: A.row_counts({n: table(s, f, n) for n in ["lineitem", "orders", "customer", "nation"]}))
    reg.add(
        "a_grain",
        with_roles('SELECT COUNT(*) AS "rows", COUNT(DISTINCT transaction_id) AS distinct_keys FROM tx'),
    )(lambda s, f: A.grain(transactions(s, f), "transaction_id"))
    reg.add(
        "a_duplicate_groups",
        with_roles("SELECT COUNT(*) AS bad FROM (SELECT transaction_id FROM tx GROUP BY 1 HAVING COUNT(*) > 1)"),
    )(lambda s, f: A.duplicate_groups(transactions(s, f), "transaction_id"))
    reg.add(
        "a_branch_daily_summary",
        with_roles(
            f"""SELECT a.branch_id, {DATE}, transaction_type, COUNT(*) AS transaction_count,
            {dbl('SUM(amount)')} AS total_amount FROM tx t JOIN account a ON t.account_id = a.account_id
            GROUP BY a.branch_id, t.transaction_date, transaction_type"""
        ),
    )(
        lambda s, f: A.branch_daily_summary(
            transactions(s, f).join(accounts(s, f).select("account_id", "branch_id"), "account_id")
        )
    )
    reg.add(
        "a_account_ids",
        "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS account_id FROM lineitem",
    )(
        lambda s, f: account_ids(
            table(s, f, "lineitem").select(
                F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit(" ")).alias("account_id")
            )
        )
    )

    # order-dependent operators over whole tables
    reg.add(
        "w_rank_tied_amounts",
        """SELECT p_partkey, p_size, RANK() OVER (ORDER BY p_size DESC) AS size_rank FROM part""",
    )(lambda s, f: O.rank_descending(table(s, f, "part").select("p_partkey", "p_size"), "p_size", "size_rank"))
    reg.add(
        "w_running_event_value",
        f"""SELECT event_id, {dbl('''SUM(CAST(value AS DECIMAL(18,2))) OVER (ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)''')} AS running_value FROM events""",
    )(
        lambda s, f: O.running_sum(
            table(s, f, "events").select("event_id", "ts", money.money(F.col("value")).alias("value")),
            ["ts", "event_id"], "value", "running_value", rows_per_bucket=1000,
        ).select("event_id", "running_value")
    )
    reg.add(
        "w_percent_of_total",
        """SELECT n_nationkey, CAST((20000 * bal + total) // (2 * total) AS DOUBLE) / 100 AS percent_of_total FROM (
            SELECT c_nationkey AS n_nationkey, SUM(CAST(abs(c_acctbal) * 100 AS HUGEINT)) AS bal,
                   SUM(SUM(CAST(abs(c_acctbal) * 100 AS HUGEINT))) OVER () AS total FROM customer GROUP BY 1)""",
    )(
        lambda s, f: O.with_percent_of_total(
            table(s, f, "customer")
            .groupBy(F.col("c_nationkey").alias("n_nationkey"))
            .agg(F.sum(F.abs(money.money(F.col("c_acctbal")))).alias("bal")),
            "bal", "percent_of_total",
        ).select("n_nationkey", "percent_of_total")
    )
    reg.add(
        "o_newest_orders",
        f"""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, {dbl('o_totalprice')} AS o_totalprice
        FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""",
    )(
        lambda s, f: O.newest(table(s, f, "orders"), ["o_orderdate", "o_orderkey"], 20).select(
            "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice"
        )
    )

    # sets
    reg.add(
        "u_stack",
        """SELECT c_custkey AS k, c_name AS name, NULL AS brand FROM customer
        UNION ALL SELECT p_partkey, p_name, p_brand FROM part""",
    )(
        lambda s, f: U.stack(
            [
                table(s, f, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")),
                table(s, f, "part").select(
                    F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")
                ),
            ]
        )
    )
    reg.add(
        "u_multiset_difference",
        """SELECT k, CAST(SUM(l) AS BIGINT) AS left_rows, CAST(SUM(r) AS BIGINT) AS right_rows FROM (
            SELECT l_orderkey AS k, 1 AS l, 0 AS r FROM lineitem UNION ALL SELECT o_orderkey, 0, 1 FROM orders)
        GROUP BY k HAVING SUM(l) <> SUM(r)""",
    )(
        lambda s, f: U.multiset_difference(
            table(s, f, "lineitem").select(F.col("l_orderkey").alias("k")),
            table(s, f, "orders").select(F.col("o_orderkey").alias("k")),
        )
    )

    # sources
    @reg.add(
        "s_synthetic_transactions",
        """SELECT COUNT(*) AS transaction_count, COUNT(*) AS distinct_ids, true AS known_accounts, true AS dates_in_range,
        true AS amounts_in_range, true AS credit_share_near_55 FROM lineitem""",
    )
    def _(s, f):
        known = table(s, f, "customer").select(F.col("c_custkey").cast("string").alias("account_id"))
        rows = table(s, f, "lineitem").count()
        made = synthetic_transactions(known, rows)
        return (
            J.with_member_flag(made, known, "account_id", "known")
            .agg(
                F.count("*").alias("transaction_count"),
                F.countDistinct("transaction_id").alias("distinct_ids"),
                F.bool_and("known").alias("known_accounts"),
                F.bool_and(F.col("transaction_date").between("2026-01-01", "2026-09-30")).alias("dates_in_range"),
                F.bool_and(F.col("amount").between(1, 5000)).alias("amounts_in_range"),
                (F.abs(F.avg(F.when(F.col("transaction_type") == "CREDIT", 1.0).otherwise(0.0)) - 0.55) < 0.02).alias(
                    "credit_share_near_55"
                ),
            )
        )

    reg.add(
        "p_cleansed",
        """SELECT CAST(o_orderkey AS VARCHAR) AS account_id, CAST(o_custkey AS VARCHAR) AS customer_id,
        o_orderpriority AS account_type, o_orderstatus AS account_status FROM orders""",
    )(
        lambda s, f: P.cleansed(
            raw_layers(s, f)[1], account_id="key", customer_id="key", account_type="text", account_status="code"
        )
    )
