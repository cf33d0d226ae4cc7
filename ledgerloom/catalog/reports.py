"""Registered reporting queries: operational, analytical and layered products."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.roles import (
    dbl,
    frames,
    mean_sql,
    payments,
    table,
    with_roles,
)
from ledgerloom.plans import analytical, audit_queries, branch_report, layered, operational
from ledgerloom.plans.customer_summary import (
    customer_360,
    customer_lookups,
    reconcile,
    store_for_lookup,
    stored_customer,
)
from ledgerloom.plans.operational import Frames
from ledgerloom.session import scratch_path

CREDITS = "COALESCE(SUM(amount) FILTER (transaction_type = 'CREDIT'), 0)"
DEBITS = "COALESCE(SUM(amount) FILTER (transaction_type = 'DEBIT'), 0)"
NET = f"({CREDITS} - COALESCE(SUM(amount) FILTER (transaction_type <> 'CREDIT'), 0))"

TOTALS = """totals AS (
    SELECT customer_id, any_value(customer_name) AS customer_name, SUM(amount) AS total
    FROM tx JOIN account USING (account_id) JOIN cust USING (customer_id) GROUP BY customer_id)"""

DAY = "CAST(transaction_date AS VARCHAR) AS transaction_date"
AMOUNT = f"{dbl('amount')} AS amount"
GROSS = dbl("SUM(amount)")
MEAN = mean_sql("SUM(amount)", "COUNT(*)")
OWNED = "tx JOIN account USING (account_id) JOIN cust USING (customer_id)"
PLACED = "tx JOIN account USING (account_id) JOIN branch USING (branch_id)"

# name -> (library query, SQL)
OPERATIONAL = {
    "oq01_transactions_with_customer": (
        "transactions_with_customer",
        f"SELECT transaction_id, {DAY}, transaction_type, {AMOUNT}, currency, account_id, customer_id, customer_name FROM {OWNED}",
    ),
    "oq02_transactions_with_branch": (
        "transactions_with_branch",
        f"SELECT transaction_id, {DAY}, transaction_type, {AMOUNT}, account_id, branch_id, branch_name, city, state FROM {PLACED}",
    ),
    "oq03_total_amount": ("total_amount", f"SELECT {GROSS} AS total_transaction_amount FROM tx"),
    "oq04_summary_by_type": (
        "summary_by_type",
        f"""SELECT transaction_type, COUNT(*) AS transaction_count, {GROSS} AS total_amount, {MEAN} AS average_amount
        FROM tx GROUP BY ALL""",
    ),
    "oq05_summary_by_customer": (
        "summary_by_customer",
        f"""SELECT customer_id, customer_name, customer_segment, COUNT(*) AS transaction_count,
        {GROSS} AS total_transaction_amount, {MEAN} AS average_transaction_amount FROM {OWNED} GROUP BY ALL""",
    ),
    "oq06_summary_by_branch": (
        "summary_by_branch",
        f"""SELECT branch_id, branch_name, city, COUNT(*) AS transaction_count, {GROSS} AS total_transaction_amount,
        {MEAN} AS average_transaction_amount FROM {PLACED} GROUP BY ALL""",
    ),
    "oq07_amount_bands": (
        "amount_bands",
        f"""SELECT transaction_id, account_id, transaction_type, {AMOUNT},
        CASE WHEN amount >= 500 THEN 'Large' WHEN amount >= 100 THEN 'Medium' ELSE 'Small' END AS amount_band FROM tx""",
    ),
    "oq08_range_by_type": (
        "range_by_type",
        f"""SELECT transaction_type, COUNT(*) AS transaction_count, {GROSS} AS total_amount, {MEAN} AS average_amount,
        {dbl('MIN(amount)')} AS minimum_amount, {dbl('MAX(amount)')} AS maximum_amount FROM tx GROUP BY ALL""",
    ),
    "oq09_customer_ranking": (
        "customer_ranking",
        f"""SELECT customer_id, customer_name, {dbl('total')} AS total_amount,
        RANK() OVER (ORDER BY total DESC) AS customer_rank FROM totals""",
    ),
    "oq11_account_activity": (
        "account_activity",
        f"""SELECT account_id, account_type, account_status, COUNT(transaction_id) AS transaction_count,
        {GROSS} AS total_amount, {mean_sql('SUM(amount)', 'NULLIF(COUNT(transaction_id), 0)')} AS average_amount
        FROM account LEFT JOIN tx USING (account_id) GROUP BY ALL""",
    ),
    "oq12_customer_accounts": (
        "customer_accounts",
        """SELECT customer_id, customer_name, account_id, account_type, branch_name, city
        FROM account JOIN cust USING (customer_id) JOIN branch USING (branch_id)""",
    ),
    "oq13_branch_by_type": (
        "branch_by_type",
        f"""SELECT branch_id, branch_name, transaction_type, COUNT(*) AS transaction_count, {GROSS} AS total_amount
        FROM {PLACED} GROUP BY ALL""",
    ),
    "oq14_above_average_customers": (
        "above_average_customers",
        f"""SELECT customer_id, customer_name, {dbl('total')} AS total_amount, {mean_sql('m.s', 'm.n')} AS average_customer_total
        FROM totals, (SELECT SUM(total) AS s, COUNT(*) AS n FROM totals) m WHERE total * m.n > m.s""",
    ),
    "oq15_customer_share": (
        "customer_share",
        f"""SELECT customer_id, customer_name, {dbl('total')} AS total_amount,
        CAST((CAST(total * 100 AS HUGEINT) * 20000 + CAST(g.s * 100 AS HUGEINT))
             // (2 * CAST(g.s * 100 AS HUGEINT)) AS DOUBLE) / 100 AS percentage_of_total
        FROM totals, (SELECT SUM(total) AS s FROM totals) g""",
    ),
}

FACT = """fact AS (
    SELECT transaction_id, account_id, customer_id, branch_id,
           CAST(strftime(transaction_date, '%Y%m%d') AS INTEGER) AS date_key,
           transaction_date, transaction_type, amount, currency
    FROM tx JOIN account USING (account_id))"""

ANALYTICAL = {
    "aq1_by_branch": (
        "by_branch",
        f"""SELECT branch_id, branch_name, COUNT(*) AS transaction_count, {GROSS} AS total_amount, {dbl(NET)} AS net_cash_flow
        FROM fact JOIN branch USING (branch_id) GROUP BY ALL""",
    ),
    "aq2_by_type": (
        "by_type",
        f"SELECT transaction_type, COUNT(*) AS transaction_count, {GROSS} AS total_amount FROM fact GROUP BY ALL",
    ),
    "aq3_by_customer": (
        "by_customer",
        f"""SELECT customer_id, customer_name, customer_segment, COUNT(*) AS transaction_count, {dbl(CREDITS)} AS total_credits,
        {dbl(DEBITS)} AS total_debits, {dbl(NET)} AS net_cash_flow FROM fact JOIN cust USING (customer_id) GROUP BY ALL""",
    ),
    "aq4_by_account": (
        "by_account",
        f"""SELECT account_id, account_type, COUNT(*) AS transaction_count, {GROSS} AS total_amount
        FROM fact JOIN (SELECT account_id, account_type FROM account) USING (account_id) GROUP BY ALL""",
    ),
    "aq5_by_date": (
        "by_date",
        f"""SELECT CAST(transaction_date AS VARCHAR) AS full_date, dayname(transaction_date) AS day_name,
        COUNT(*) AS transaction_count, {GROSS} AS total_amount, {dbl(NET)} AS net_cash_flow
        FROM fact GROUP BY transaction_date""",
    ),
    "aq6_by_segment_and_branch": (
        "by_segment_and_branch",
        f"""SELECT customer_segment, branch_name, COUNT(*) AS transaction_count, {GROSS} AS total_amount
        FROM fact JOIN cust USING (customer_id) JOIN branch USING (branch_id) GROUP BY ALL""",
    ),
    "aq7_net_outflow_accounts": (
        "net_outflow_accounts",
        f"""SELECT * FROM (SELECT account_id, account_type, {dbl(CREDITS)} AS total_credits, {dbl(DEBITS)} AS total_debits,
        {dbl(NET)} AS net_cash_flow FROM fact JOIN (SELECT account_id, account_type FROM account) USING (account_id)
        GROUP BY ALL) WHERE net_cash_flow < 0""",
    ),
}

C360 = f"""owned AS (
    SELECT c_custkey AS account_id, c_nationkey AS customer_id, c_acctbal AS balance FROM customer),
person AS (SELECT n_nationkey AS customer_id, n_name AS customer_name FROM nation),
metrics AS (
    SELECT a.customer_id, COUNT(t.transaction_id) AS transaction_count,
           COALESCE(SUM(t.amount), 0) AS total, MAX(t.transaction_date) AS last_date
    FROM owned a LEFT JOIN pay t ON a.account_id = t.account_id GROUP BY a.customer_id),
holdings AS (SELECT customer_id, COUNT(*) AS account_count FROM owned GROUP BY customer_id),
c360 AS (
    SELECT p.customer_id, p.customer_name, COALESCE(h.account_count, 0) AS account_count,
           COALESCE(m.transaction_count, 0) AS transaction_count,
           {dbl('COALESCE(m.total, 0)')} AS total_transaction_amount,
           CAST(m.last_date AS VARCHAR) AS last_transaction_date
    FROM person p LEFT JOIN holdings h USING (customer_id) LEFT JOIN metrics m USING (customer_id))"""

# raw rows of the layered models, with untidy text to clean
LAYER_SQL = """raw_c AS (
    SELECT CAST(c_custkey AS VARCHAR) AS customer_id, '  ' || c_name || ' ' AS customer_name,
           n_name || ' ' AS city, ' ' || c_mktsegment AS customer_segment
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
raw_a AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS account_id, CAST(o_custkey AS VARCHAR) AS customer_id,
           o_orderpriority || '  ' AS account_type, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS opened_date,
           ' ' || lower(o_orderstatus) AS account_status
    FROM orders),
raw_t AS (
    SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS transaction_id,
           CAST(l_orderkey AS VARCHAR) AS account_id,
           CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS transaction_date,
           CAST(CASE WHEN l_tax = 0.08 THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS amount,
           CASE l_returnflag WHEN 'A' THEN ' deposit' WHEN 'N' THEN 'Purchase ' WHEN 'R'
                THEN CASE WHEN l_linestatus = 'F' THEN 'withdrawal' ELSE 'fee' END END AS transaction_type,
           ' usd ' AS currency
    FROM lineitem),
stg_c AS (SELECT customer_id, TRIM(customer_name) AS customer_name, TRIM(city) AS city,
                 TRIM(customer_segment) AS customer_segment FROM raw_c),
stg_a AS (SELECT account_id, customer_id, TRIM(account_type) AS account_type, CAST(opened_date AS DATE) AS opened_date,
                 UPPER(TRIM(account_status)) AS account_status FROM raw_a),
stg_t AS (SELECT transaction_id, account_id, CAST(transaction_date AS DATE) AS transaction_date,
                 CAST(amount AS DECIMAL(18,2)) AS amount, UPPER(TRIM(transaction_type)) AS transaction_type,
                 UPPER(TRIM(currency)) AS currency FROM raw_t),
enriched AS (
    SELECT t.transaction_id, t.account_id, a.customer_id, c.customer_name, c.city, c.customer_segment,
           a.account_type, a.opened_date, a.account_status, t.transaction_date, t.amount, t.transaction_type,
           t.currency,
           t.amount * CASE t.transaction_type WHEN 'DEPOSIT' THEN 1 WHEN 'PURCHASE' THEN -1 WHEN 'WITHDRAWAL' THEN -1 END
               AS signed_amount
    FROM stg_t t JOIN stg_a a ON t.account_id = a.account_id JOIN stg_c c ON a.customer_id = c.customer_id)"""

LAYER_ORACLES = {
    "stg_customers": "SELECT * FROM stg_c",
    "stg_accounts": """SELECT account_id, customer_id, account_type, CAST(opened_date AS VARCHAR) AS opened_date,
        account_status FROM stg_a""",
    "stg_transactions": f"""SELECT transaction_id, account_id, CAST(transaction_date AS VARCHAR) AS transaction_date,
        {dbl('amount')} AS amount, transaction_type, currency FROM stg_t""",
    "int_transaction_enriched": f"""SELECT transaction_id, account_id, customer_id, customer_name, city,
        customer_segment, account_type, CAST(opened_date AS VARCHAR) AS opened_date, account_status,
        CAST(transaction_date AS VARCHAR) AS transaction_date, {dbl('amount')} AS amount, transaction_type, currency,
        {dbl('signed_amount')} AS signed_amount FROM enriched""",
    "dim_accounts": """SELECT a.account_id, a.customer_id, c.customer_name, c.city, c.customer_segment,
        a.account_type, CAST(a.opened_date AS VARCHAR) AS opened_date, a.account_status
        FROM stg_a a LEFT JOIN stg_c c ON a.customer_id = c.customer_id""",
    "fct_daily_account_activity": f"""SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, account_id,
        COUNT(*) AS transaction_count,
        {dbl("COALESCE(SUM(amount) FILTER (signed_amount = amount), 0)")} AS total_deposits,
        {dbl("COALESCE(SUM(amount) FILTER (signed_amount = -amount), 0)")} AS total_outflows,
        {dbl('SUM(signed_amount)')} AS net_amount
        FROM enriched GROUP BY transaction_date, account_id""",
}


def raw_layers(spark, folder):
    """Untidy raw text tables for the layered models."""
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    orders, line = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    raw_c = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("customer_name"),
        F.concat("n_name", F.lit(" ")).alias("city"),
        F.concat(F.lit(" "), "c_mktsegment").alias("customer_segment"),
    )
    raw_a = orders.select(
        F.col("o_orderkey").cast("string").alias("account_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.concat("o_orderpriority", F.lit("  ")).alias("account_type"),
        F.col("o_orderdate").cast("date").cast("string").alias("opened_date"),
        F.concat(F.lit(" "), F.lower("o_orderstatus")).alias("account_status"),
    )
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    kind = (
        F.when(F.col("l_returnflag") == "A", " deposit")
        .when(F.col("l_returnflag") == "N", "Purchase ")
        .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "withdrawal")
        .when(F.col("l_returnflag") == "R", "fee")
    )
    raw_t = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("transaction_id"),
        F.col("l_orderkey").cast("string").alias("account_id"),
        F.col("l_shipdate").cast("date").cast("string").alias("transaction_date"),
        F.when(F.col("l_tax") == 0.08, -price).otherwise(price).cast("string").alias("amount"),
        kind.alias("transaction_type"),
        F.lit(" usd ").alias("currency"),
    )
    return raw_c, raw_a, raw_t


def nation_customers(spark, folder):
    """Customer summary roles: customer = nation, account = customer, transaction = orders."""
    people = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("customer_id"), F.col("n_name").alias("customer_name")
    )
    owned = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_nationkey").alias("customer_id"),
        F.col("c_acctbal").alias("balance"),
    )
    return people, owned, payments(spark, folder)


def register(reg) -> None:
    for name, (query, sql) in OPERATIONAL.items():
        reg.add(name, with_roles(sql, TOTALS))(
            lambda spark, folder, query=query: operational.QUERIES[query](frames(spark, folder))
        )

    @reg.add(
        "oq10_running_total",
        with_roles(
            f"""SELECT transaction_id, CAST(transaction_date AS VARCHAR) AS transaction_date, transaction_type,
            {dbl('amount')} AS amount, {dbl('''SUM(amount) OVER (ORDER BY transaction_date, transaction_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)''')} AS running_total FROM pay"""
        ),
    )
    def _(spark, folder):
        pay = payments(spark, folder)
        return operational.running_total(Frames(pay, pay, pay, pay))

    for name, (query, sql) in ANALYTICAL.items():
        reg.add(name, with_roles(sql, FACT))(
            lambda spark, folder, query=query: analytical.QUERIES[query](analytical.build_star(frames(spark, folder)))
        )

    star_tables = {
        "star_dim_customer": ("dim_customer", "SELECT * FROM cust"),
        "star_dim_account": ("dim_account", "SELECT account_id, account_type, account_status FROM account"),
        "star_dim_branch": ("dim_branch", "SELECT * FROM branch"),
        "star_dim_date": (
            "dim_date",
            """SELECT DISTINCT CAST(strftime(transaction_date, '%Y%m%d') AS INTEGER) AS date_key,
            CAST(transaction_date AS VARCHAR) AS full_date, CAST(year(transaction_date) AS INTEGER) AS year,
            CAST(month(transaction_date) AS INTEGER) AS month, CAST(day(transaction_date) AS INTEGER) AS day,
            dayname(transaction_date) AS day_name FROM tx""",
        ),
        "star_fact_transaction": (
            "fact_transaction",
            f"""SELECT transaction_id, account_id, customer_id, branch_id, date_key, transaction_type,
            {dbl('amount')} AS amount, currency FROM fact""",
        ),
    }
    for name, (part, sql) in star_tables.items():
        reg.add(name, with_roles(sql, FACT))(
            lambda spark, folder, part=part: getattr(analytical.build_star(frames(spark, folder)), part)
        )

    branch_sql = with_roles(
        f"""SELECT a.branch_id, COUNT(*) AS transaction_count, {dbl('SUM(amount)')} AS gross_amount,
        {dbl(NET)} AS net_cash_flow FROM tx t JOIN account a ON t.account_id = a.account_id GROUP BY a.branch_id"""
    )
    reg.add("branch_report", branch_sql)(lambda s, f: branch_report.branch_summary(frames(s, f)))
    reg.add("branch_report_sql", branch_sql)(lambda s, f: branch_report.branch_summary_sql(frames(s, f)))

    for model, sql in LAYER_ORACLES.items():
        reg.add(f"layer_{model}", f"WITH {LAYER_SQL}\n{sql}")(
            lambda spark, folder, model=model: layered.build_layers(*raw_layers(spark, folder))[model]
        )

    def c360(spark, folder):
        people, owned, pay = nation_customers(spark, folder)
        return customer_360(people, owned, pay)

    reg.add("customer_360", with_roles("SELECT * FROM c360", C360))(c360)

    @reg.add(
        "customer_360_reconciliation",
        with_roles(
            f"""SELECT COUNT(a.account_id) AS mapped_silver_transactions,
            COUNT(*) - COUNT(a.account_id) AS unmapped_silver_transactions,
            {dbl('SUM(CASE WHEN a.account_id IS NOT NULL THEN t.amount ELSE 0 END)')} AS mapped_silver_amount,
            COUNT(a.account_id) AS gold_transaction_count,
            {dbl('SUM(CASE WHEN a.account_id IS NOT NULL THEN t.amount ELSE 0 END)')} AS gold_total_amount
            FROM pay t LEFT JOIN (SELECT * FROM owned WHERE balance >= 0) a ON a.account_id = t.account_id""",
            C360,
        ),
    )
    def _(spark, folder):
        people, owned, pay = nation_customers(spark, folder)
        owned = owned.filter(F.col("balance") >= 0)
        return reconcile(customer_360(people, owned, pay), pay, owned)

    @reg.add(
        "customer_360_lookup",
        with_roles(
            """SELECT customer_id, account_count, transaction_count, total_transaction_amount FROM c360
            WHERE customer_id IN (SELECT s_nationkey FROM supplier)""",
            C360,
        ),
    )
    def _(spark, folder):
        gold = c360(spark, folder).withColumn("customer_id", F.col("customer_id").cast("string"))
        ids = table(spark, folder, "supplier").select(
            F.concat(F.lit(" "), F.col("s_nationkey").cast("string"), F.lit(" ")).alias("customer_id")
        )
        return customer_lookups(gold, ids).withColumn("customer_id", F.col("customer_id").cast("int"))

    @reg.add(
        "customer_360_stored_lookup",
        with_roles(
            """SELECT customer_id, account_count, transaction_count, total_transaction_amount FROM c360
            WHERE CAST(customer_id AS VARCHAR) = (SELECT MAX(CAST(s_nationkey AS VARCHAR)) FROM supplier)""",
            C360,
        ),
    )
    def _(spark, folder):
        base = scratch_path(spark, "lookup")
        gold = c360(spark, folder).withColumn("customer_id", F.col("customer_id").cast("string"))
        store_for_lookup(gold, base, rows_per_file=5)
        last = table(spark, folder, "supplier").agg(F.max(F.col("s_nationkey").cast("string")).alias("id")).first().id
        return stored_customer(spark, base, last or "none").withColumn("customer_id", F.col("customer_id").cast("int"))

    # audit questions: a run is a day of events, a file is a user's events of that day
    runs_sql = """runs AS (
        SELECT 'RUN_' || strftime(ts, '%Y%m%d') AS run_id, MIN(ts) AS started_at,
               CASE WHEN COUNT(*) FILTER (event_type = 'error') > 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
               'events=' || COUNT(*) AS status_reason
        FROM events GROUP BY 1),
    file_audit AS (
        SELECT 'RUN_' || strftime(ts, '%Y%m%d') AS run_id, 'U' || user_id || '.csv' AS source_filename,
               MAX(ts) AS event_ts, COUNT(*) AS source_rows, COUNT(*) FILTER (event_type <> 'error') AS accepted_rows,
               COUNT(*) FILTER (event_type = 'error') AS rejected_rows, 'PROCESSED' AS file_status,
               MIN(CAST(ts AS DATE)) + CASE WHEN MAX(hour(ts)) >= 12 THEN 1 ELSE 0 END AS file_date
        FROM events GROUP BY ts::DATE, run_id, user_id),
    silver AS (
        SELECT event_id AS transaction_id, CAST(ts AS DATE) AS transaction_date,
               'RUN_' || strftime(ts, '%Y%m%d') AS run_id, 'U' || user_id || '.csv' AS source_filename,
               CAST(value AS DECIMAL(18,2)) AS amount, user_id
        FROM events WHERE event_type <> 'error')"""

    def audit_tables(spark, folder):
        events = table(spark, folder, "events").withColumns(
            {
                "run_id": F.concat(F.lit("RUN_"), F.date_format("ts", "yyyyMMdd")),
                "source_filename": F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit(".csv")),
            }
        )
        error = F.col("event_type") == "error"
        runs = events.groupBy("run_id").agg(
            F.min("ts").alias("started_at"),
            F.when(F.count_if(error) > 0, "FAILED").otherwise("SUCCESS").alias("status"),
            F.concat(F.lit("events="), F.count("*").cast("string")).alias("status_reason"),
        )
        files = events.groupBy("run_id", "source_filename", "user_id").agg(
            F.max("ts").alias("event_ts"),
            F.count("*").alias("source_rows"),
            F.count_if(~error).alias("accepted_rows"),
            F.count_if(error).alias("rejected_rows"),
            F.lit("PROCESSED").alias("file_status"),
            F.date_add(
                F.min(F.col("ts").cast("date")), F.when(F.max(F.hour("ts")) >= 12, 1).otherwise(0)
            ).alias("file_date"),
        )
        silver = events.filter(~error).select(
            F.col("event_id").alias("transaction_id"),
            F.col("ts").cast("date").alias("transaction_date"),
            "run_id",
            "source_filename",
            F.col("value").cast("decimal(18,2)").alias("amount"),
            "user_id",
        )
        rejected = events.filter(error).select(
            "run_id", "source_filename", F.col("event_id").alias("source_row_number"),
            F.col("event_id").alias("transaction_id"), F.col("props").alias("rejection_reasons"),
        )
        return runs, files, silver, rejected

    @reg.add(
        "rqa_latest_runs",
        f"WITH {runs_sql} SELECT run_id, status, status_reason FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 5",
    )
    def _(spark, folder):
        return audit_queries.latest_runs(audit_tables(spark, folder)[0])

    @reg.add(
        "rqb_file_reconciliation",
        f"""WITH {runs_sql} SELECT source_filename, file_status, source_rows, accepted_rows, rejected_rows
        FROM file_audit ORDER BY event_ts DESC, run_id DESC, source_filename DESC LIMIT 20""",
    )
    def _(spark, folder):
        return audit_queries.file_reconciliation(audit_tables(spark, folder)[1])

    @reg.add(
        "rqc_gold_against_silver",
        f"WITH {runs_sql} SELECT {dbl('SUM(amount)')} AS gold_total, {dbl('SUM(amount)')} AS silver_total FROM silver",
    )
    def _(spark, folder):
        silver = audit_tables(spark, folder)[2]
        gold = silver.groupBy("user_id", "transaction_date").agg(F.sum("amount").alias("total_amount"))
        return audit_queries.gold_against_silver(gold, silver)

    @reg.add(
        "rqd_latest_exceptions",
        """SELECT 'U' || user_id || '.csv' AS source_filename, event_id AS source_row_number,
        event_id AS transaction_id, props AS rejection_reasons FROM events WHERE event_type = 'error'
        ORDER BY 'RUN_' || strftime(ts, '%Y%m%d') DESC, 1 DESC, 2 DESC LIMIT 20""",
    )
    def _(spark, folder):
        return audit_queries.latest_exceptions(audit_tables(spark, folder)[3])

    @reg.add(
        "rqe_date_disagreements",
        f"""WITH {runs_sql} SELECT s.transaction_id, CAST(s.transaction_date AS VARCHAR) AS transaction_date,
        CAST(f.file_date AS VARCHAR) AS file_date, s.source_filename FROM silver s
        JOIN file_audit f ON f.run_id = s.run_id AND f.source_filename = s.source_filename
        WHERE s.transaction_date <> f.file_date""",
    )
    def _(spark, folder):
        _, files, silver, _ = audit_tables(spark, folder)
        return audit_queries.date_disagreements(silver, files)
