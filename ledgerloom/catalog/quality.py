"""Registered data-quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.feed import FEED_SQL, feed
from ledgerloom.catalog.reports import LAYER_SQL, raw_layers
from ledgerloom.catalog.roles import (
    accounts,
    branches,
    customers,
    dbl,
    payments,
    table,
    transactions,
    with_roles,
)
from ledgerloom.functions.text import join_reasons
from ledgerloom.operators import quality as Q
from ledgerloom.operators import rules as R
from ledgerloom.operators.aggregates import by_branch, reason_counts
from ledgerloom.plans import layered
from ledgerloom.plans.customer_summary import (
    CUSTOMER,
    check_accounts,
    check_customers,
    check_silver,
    exception_records,
    exceptions_by_entity,
    import_exceptions,
)
from ledgerloom.plans.delivery import files_read, validate_all
from ledgerloom.session import materialize
from ledgerloom.sinks.reports import split_outputs

VALIDATED_SQL = f"""{FEED_SQL},
validated AS (
    SELECT *, concat_ws('; ', NULLIF(value_reasons, ''),
        CASE WHEN COUNT(*) OVER (PARTITION BY NULLIF(transaction_id, '')) > 1 AND transaction_id <> ''
             THEN '{R.REPEATED_ID}' END) AS error_reason
    FROM ruled)"""

SIX = "transaction_id, account_id, transaction_date, transaction_type, amount, currency"


def validated(spark, folder):
    rows = feed(spark, folder).withColumn(
        "transaction_id", F.nullif("transaction_id", F.lit(""))
    )
    return validate_all(rows)


def listed_files(spark, folder):
    """Every file of the feed, one without rows and one that could not be read."""
    return (
        feed(spark, folder)
        .select(F.col("source_file").alias("file"), F.lit(None).cast("string").alias("error"))
        .distinct()
        .unionByName(
            table(spark, folder, "region").select(
                F.concat(F.lit("BR9_"), "r_name", F.lit("_TRANSACTION.csv")).alias("file"),
                F.when(F.col("r_name") == "ASIA", "Missing required column(s): currency").alias("error"),
            )
        )
    )


# transactions with NULLs, and reference tables with gaps
DIRTY_SQL = """dirty AS (
    SELECT CASE WHEN l_tax = 0 AND l_discount = 0 THEN NULL ELSE l_orderkey * 10 + l_linenumber END AS transaction_id,
           CASE WHEN l_quantity = 1 THEN NULL ELSE l_orderkey END AS account_id,
           CASE WHEN l_quantity = 2 THEN NULL WHEN l_quantity = 3 THEN -CAST(l_extendedprice AS DECIMAL(18,2))
                ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount,
           CASE WHEN l_quantity = 50 THEN 'TRANSFER' WHEN l_linestatus = 'F' THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type,
           CASE WHEN l_discount = 0.1 THEN 'EUR' ELSE 'USD' END AS currency
    FROM lineitem),
some_account AS (SELECT * FROM account WHERE account_status <> 'P'),
some_cust AS (SELECT c_custkey AS customer_id FROM customer WHERE c_acctbal >= 0),
some_branch AS (SELECT * FROM branch WHERE state <> 'ASIA')"""


def dirty(spark, folder):
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice").cast("decimal(18,2)")
    tx = table(spark, folder, "lineitem").select(
        F.when(~((F.col("l_tax") == 0) & (F.col("l_discount") == 0)), F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(
            "transaction_id"
        ),
        F.when(quantity != 1, F.col("l_orderkey")).alias("account_id"),
        F.when(quantity == 3, -price).when(quantity != 2, price).alias("amount"),
        F.when(quantity == 50, "TRANSFER").when(F.col("l_linestatus") == "F", "CREDIT").otherwise("DEBIT").alias(
            "transaction_type"
        ),
        F.when(F.col("l_discount") == 0.1, "EUR").otherwise("USD").alias("currency"),
    )
    return (
        tx,
        accounts(spark, folder).filter(F.col("account_status") != "P"),
        table(spark, folder, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("customer_id")),
        branches(spark, folder).filter(F.col("state") != "ASIA"),
    )


CHECKS_SQL = f"""checks AS (
    SELECT '{Q.NULL_IDS}' AS "check", COUNT(*) FILTER (transaction_id IS NULL) AS bad FROM dirty
    UNION ALL SELECT '{Q.NULL_ACCOUNTS}', COUNT(*) FILTER (account_id IS NULL) FROM dirty
    UNION ALL SELECT '{Q.NULL_AMOUNTS}', COUNT(*) FILTER (amount IS NULL) FROM dirty
    UNION ALL SELECT '{Q.DUPLICATE_IDS}', COUNT(*) FROM
        (SELECT transaction_id FROM dirty GROUP BY transaction_id HAVING COUNT(*) > 1)
    UNION ALL SELECT '{Q.ORPHAN_TRANSACTIONS}', COUNT(*) FROM dirty d
        WHERE d.account_id IS NOT NULL AND d.account_id NOT IN (SELECT account_id FROM some_account)
    UNION ALL SELECT '{Q.ORPHAN_CUSTOMERS}', COUNT(*) FROM some_account
        WHERE customer_id NOT IN (SELECT customer_id FROM some_cust)
    UNION ALL SELECT '{Q.ORPHAN_BRANCHES}', COUNT(*) FROM some_account
        WHERE branch_id NOT IN (SELECT branch_id FROM some_branch)
    UNION ALL SELECT '{Q.BAD_AMOUNTS}', COUNT(*) FILTER (amount <= 0) FROM dirty)"""


def _test_sql(name: str, body: str) -> str:
    return (
        f"SELECT '{name}' AS test_name, COUNT(*) AS failing_values, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS failing_rows, "
        f"COUNT(*) = 0 AS passed FROM ({body})"
    )


def _unique(table_name, column):
    return f"SELECT {column}, COUNT(*) AS n FROM {table_name} WHERE {column} IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1"


def _null(table_name, column):
    return f"SELECT {column}, COUNT(*) AS n FROM {table_name} WHERE {column} IS NULL GROUP BY 1"


def _orphan(child, column, parent, field):
    return (
        f"SELECT {column}, COUNT(*) AS n FROM {child} WHERE {column} IS NOT NULL "
        f"AND {column} NOT IN (SELECT {field} FROM {parent}) GROUP BY 1"
    )


LAYER_TESTS_SQL = " UNION ALL ".join(
    _test_sql(*pair)
    for pair in [
        ("unique_stg_customers_customer_id", _unique("stg_c", "customer_id")),
        ("not_null_stg_customers_customer_id", _null("stg_c", "customer_id")),
        ("unique_stg_accounts_account_id", _unique("stg_a", "account_id")),
        ("not_null_stg_accounts_account_id", _null("stg_a", "account_id")),
        ("not_null_stg_accounts_customer_id", _null("stg_a", "customer_id")),
        ("relationships_stg_accounts_customer_id", _orphan("stg_a", "customer_id", "stg_c", "customer_id")),
        ("unique_stg_transactions_transaction_id", _unique("stg_t", "transaction_id")),
        ("not_null_stg_transactions_transaction_id", _null("stg_t", "transaction_id")),
        ("not_null_stg_transactions_account_id", _null("stg_t", "account_id")),
        ("relationships_stg_transactions_account_id", _orphan("stg_t", "account_id", "stg_a", "account_id")),
        (
            "accepted_values_stg_transactions_transaction_type",
            "SELECT transaction_type, COUNT(*) AS n FROM stg_t WHERE transaction_type NOT IN "
            "('DEPOSIT', 'PURCHASE', 'WITHDRAWAL') GROUP BY 1",
        ),
        (
            "assert_nonnegative_transaction_amount",
            "SELECT amount, COUNT(*) AS n FROM raw_t WHERE TRY_CAST(amount AS DECIMAL(18,2)) < 0 GROUP BY 1",
        ),
    ]
)

# reference rows: each customer id occurs once per order, each account id once per line
REF_SQL = f"""cust_rows AS (
    SELECT o_orderkey AS source_row_number, CAST(o_custkey AS VARCHAR) AS customer_id,
           CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'name ' || o_custkey END AS customer_name,
           CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS customer_segment
    FROM orders),
cust_base AS (
    SELECT *, concat_ws('; ', CASE WHEN customer_name = '' THEN '{R.CUSTOMER_NAME_MISSING}' END,
        CASE WHEN customer_segment = '' THEN '{R.CUSTOMER_SEGMENT_MISSING}' END) AS base FROM cust_rows),
cust_checked AS (
    SELECT *, concat_ws('; ', NULLIF(base, ''), CASE WHEN source_row_number >
        MIN(CASE WHEN base = '' THEN source_row_number END) OVER (PARTITION BY customer_id)
        THEN '{R.CUSTOMER_REPEATED}' END) AS reasons FROM cust_base)"""

ACC_SQL = f"""acc_rows AS (
    SELECT l_linenumber + 10 * (l_partkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT)) AS source_row_number,
           CAST(l_orderkey AS VARCHAR) AS account_id, CAST(l_suppkey AS VARCHAR) AS customer_id,
           CASE WHEN l_quantity = 1 THEN '' ELSE l_returnflag END AS branch_id,
           CASE WHEN l_quantity = 2 THEN '' ELSE 'CHECKING' END AS account_type, l_linestatus AS account_status
    FROM lineitem),
acc_base AS (
    SELECT *, concat_ws('; ', CASE WHEN branch_id = '' THEN '{R.BRANCH_ID_MISSING}' END,
            CASE WHEN account_type = '' THEN '{R.ACCOUNT_TYPE_MISSING}' END) AS before,
        customer_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal >= 0) AS orphan FROM acc_rows),
acc_checked AS (
    SELECT *, concat_ws('; ', NULLIF(before, ''), CASE WHEN source_row_number >
        MIN(CASE WHEN before = '' AND NOT orphan THEN source_row_number END) OVER (PARTITION BY account_id)
        THEN '{R.ACCOUNT_REPEATED}' END, CASE WHEN orphan THEN '{R.CUSTOMER_UNKNOWN}' END) AS reasons FROM acc_base)"""


def customer_rows(spark, folder):
    return table(spark, folder, "orders").select(
        F.lit("customers.csv").alias("source_filename"),
        F.col("o_orderkey").alias("source_row_number"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("name "), F.col("o_custkey").cast("string"))).alias(
            "customer_name"
        ),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("customer_segment"),
        F.array().cast("array<string>").alias("row_issues"),
    )


def account_rows(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.lit("accounts.csv").alias("source_filename"),
        (
            F.col("l_linenumber")
            + 10 * (F.col("l_partkey") * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("long"))
        ).alias("source_row_number"),
        F.col("l_orderkey").cast("string").alias("account_id"),
        F.col("l_suppkey").cast("string").alias("customer_id"),
        F.when(F.col("l_quantity") == 1, "").otherwise(F.col("l_returnflag")).alias("branch_id"),
        F.when(F.col("l_quantity") == 2, "").otherwise("CHECKING").alias("account_type"),
        F.col("l_linestatus").alias("account_status"),
        F.array().cast("array<string>").alias("row_issues"),
    )


# accepted transactions as the customer summary re-checks them
SILVER_SQL = f"""slv AS (
    SELECT CASE WHEN l_tax = 0 AND l_discount = 0 THEN '' ELSE 'T' || l_orderkey || '-' || l_linenumber END AS transaction_id,
           CASE WHEN l_quantity = 1 THEN '' ELSE CAST(l_orderkey AS VARCHAR) END AS account_id,
           CASE WHEN l_quantity = 2 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS transaction_date,
           CASE WHEN l_quantity = 3 THEN '' WHEN l_linestatus = 'F' THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type,
           CASE WHEN l_quantity = 4 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount,
           CASE WHEN l_quantity = 5 THEN '' ELSE 'USD' END AS currency,
           'F' || year(l_shipdate) AS source_filename,
           l_partkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS source_row_number
    FROM lineitem),
slv_checked AS (
    SELECT s.*, a.customer_id, concat_ws('; ',
        CASE WHEN s.transaction_id = '' THEN '{R.ID_MISSING}' END,
        CASE WHEN s.transaction_id <> '' AND ROW_NUMBER() OVER (PARTITION BY s.transaction_id
            ORDER BY s.source_filename, s.source_row_number) > 1 THEN '{R.SILVER_REPEATED}' END,
        CASE WHEN s.account_id = '' THEN '{R.ACCOUNT_MISSING}' WHEN a.account_id IS NULL THEN '{R.ACCOUNT_UNMAPPED}' END,
        CASE WHEN s.transaction_date IS NULL THEN '{R.DATE_MISSING}' END,
        CASE WHEN s.transaction_type = '' THEN '{R.TYPE_MISSING}' END,
        CASE WHEN s.amount IS NULL THEN '{R.AMOUNT_MISSING}' END,
        CASE WHEN s.currency = '' THEN '{R.CURRENCY_MISSING}' END) AS reasons
    FROM slv s LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS account_id, CAST(o_custkey AS VARCHAR) AS customer_id
                          FROM orders WHERE o_orderstatus <> 'P') a ON s.account_id = a.account_id)"""


def silver_rows(spark, folder):
    quantity = F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        F.when((F.col("l_tax") == 0) & (F.col("l_discount") == 0), "")
        .otherwise(F.concat(F.lit("T"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")))
        .alias("transaction_id"),
        F.when(quantity == 1, "").otherwise(F.col("l_orderkey").cast("string")).alias("account_id"),
        F.when(quantity != 2, F.col("l_shipdate").cast("date")).alias("transaction_date"),
        F.when(quantity == 3, "").when(F.col("l_linestatus") == "F", "CREDIT").otherwise("DEBIT").alias("transaction_type"),
        F.when(quantity != 4, F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"),
        F.when(quantity == 5, "").otherwise("USD").alias("currency"),
        F.concat(F.lit("F"), F.year("l_shipdate").cast("string")).alias("source_filename"),
        (F.col("l_partkey") * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("source_row_number"),
    )


def owner_map(spark, folder):
    return table(spark, folder, "orders").filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").cast("string").alias("account_id"), F.col("o_custkey").cast("string").alias("customer_id")
    )


def register(reg) -> None:
    reg.add(
        "dq_validated_rows",
        f"WITH {VALIDATED_SQL} SELECT place, source_file, NULLIF(transaction_id, '') AS transaction_id, account_id, "
        "transaction_date, transaction_type, amount, currency, error_reason, error_reason = '' AS is_valid FROM validated",
    )(
        lambda s, f: validated(s, f).select(
            "place", "source_file", "transaction_id", "account_id", "transaction_date", "transaction_type",
            "amount", "currency", "error_reason", "is_valid",
        )
    )
    reg.add(
        "dq_valid_rows",
        f"WITH {VALIDATED_SQL} SELECT place, {SIX} FROM validated WHERE error_reason = ''",
    )(
        lambda s, f: split_outputs(validated(s, f))[0].select("place", *SIX.split(", "))
    )
    reasons = [R.ID_MISSING, R.ACCOUNT_MISSING, R.BAD_DATE, R.BAD_TYPE, R.BAD_AMOUNT, R.BAD_CURRENCY, R.REPEATED_ID]
    reason_sql = " UNION ALL ".join(
        f"SELECT '{text}' AS reason, COUNT(*) AS \"rows\" FROM validated WHERE contains(error_reason, '{text}')"
        for text in reasons
    )
    reg.add("dq_reason_counts", f"WITH {VALIDATED_SQL} {reason_sql}")(lambda s, f: reason_counts(validated(s, f)))
    metric_sql = f"""WITH {VALIDATED_SQL}, files AS (
        SELECT DISTINCT source_file AS file, NULL AS error FROM feed
        UNION ALL SELECT 'BR9_' || r_name || '_TRANSACTION.csv',
            CASE WHEN r_name = 'ASIA' THEN 'Missing required column(s): currency' END FROM region),
    n AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (error_reason = '') AS valid,
                 COUNT(*) FILTER (contains(error_reason, '{R.REPEATED_ID}')) AS repeated FROM validated),
    f AS (SELECT COUNT(*) AS files, COUNT(*) FILTER (error IS NULL) AS readable FROM files)
    SELECT '{Q.M_DISCOVERED}' AS metric, CAST(files AS VARCHAR) AS value FROM f
    UNION ALL SELECT '{Q.M_READ}', CAST(readable AS VARCHAR) FROM f
    UNION ALL SELECT '{Q.M_REJECTED}', CAST(files - readable AS VARCHAR) FROM f
    UNION ALL SELECT '{Q.M_TOTAL}', CAST(total AS VARCHAR) FROM n
    UNION ALL SELECT '{Q.M_VALID}', CAST(valid AS VARCHAR) FROM n
    UNION ALL SELECT '{Q.M_INVALID}', CAST(total - valid AS VARCHAR) FROM n
    UNION ALL SELECT '{Q.M_RATE}', CAST(CAST((20000 * (total - valid) + total) // (2 * total) AS DOUBLE) / 100 AS VARCHAR) FROM n
    UNION ALL SELECT '{Q.M_DUPLICATE}', CAST(repeated AS VARCHAR) FROM n
    UNION ALL SELECT '{Q.P_FILE}' || file, CAST(COUNT(v.source_file) AS VARCHAR) FROM files
        LEFT JOIN validated v ON v.source_file = file WHERE error IS NULL GROUP BY file
    UNION ALL SELECT '{Q.P_REASON}' || reason, CAST("rows" AS VARCHAR) FROM ({reason_sql})
    UNION ALL SELECT '{Q.P_ERROR}' || file, error FROM files WHERE error IS NOT NULL"""
    reg.add("dq_metric_table", metric_sql)(
        lambda s, f: Q.metric_table(
            materialize(validated(s, f), "validated"), listed_files(s, f), R.REPEATED_ID
        )
    )
    reg.add(
        "dq_files_read",
        f"""WITH {FEED_SQL} SELECT source_file AS file, COUNT(*) AS row_count FROM feed GROUP BY 1
        UNION ALL SELECT 'BR9_' || r_name || '_TRANSACTION.csv', 0 FROM region WHERE r_name <> 'ASIA'""",
    )(lambda s, f: files_read(feed(s, f), listed_files(s, f)))

    reg.add(
        "dq_checks",
        with_roles("""SELECT "check", bad, CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM checks""", DIRTY_SQL, CHECKS_SQL),
    )(lambda s, f: Q.with_status(Q.run_checks(*dirty(s, f))))

    @reg.add("dq_layer_tests", f"WITH {LAYER_SQL} {LAYER_TESTS_SQL}")
    def _(s, f):
        raw = raw_layers(s, f)
        return layered.layer_test_results(layered.build_layers(*raw), raw[2])

    reg.add(
        "dq_negative_amounts",
        f"WITH {LAYER_SQL} SELECT transaction_id, amount FROM raw_t WHERE TRY_CAST(amount AS DECIMAL(18,2)) < 0",
    )(lambda s, f: Q.negative_amounts(raw_layers(s, f)[2]))
    reg.add(
        "dq_accepted_values",
        "SELECT event_type AS failing_value, COUNT(*) AS failing_rows FROM events "
        "WHERE event_type NOT IN ('click', 'view') GROUP BY 1",
    )(lambda s, f: Q.not_accepted(table(s, f, "events"), "event_type", ["click", "view"]))
    reg.add(
        "dq_constraints",
        with_roles(
            """SELECT d.transaction_id, d.account_id, d.amount * 100 AS cents, d.transaction_type, d.currency, concat_ws('; ',
            CASE WHEN d.transaction_id IS NULL OR COUNT(*) OVER (PARTITION BY d.transaction_id) > 1
                 THEN 'bank_transaction primary key transaction_id' END,
            CASE WHEN d.account_id IS NULL THEN 'bank_transaction not null account_id' END,
            CASE WHEN d.amount IS NULL THEN 'bank_transaction not null amount' END,
            CASE WHEN d.account_id IS NOT NULL AND s.account_id IS NULL THEN 'bank_transaction foreign key account_id' END,
            CASE WHEN d.transaction_type = 'TRANSFER' THEN 'bank_transaction check transaction_type' END,
            CASE WHEN d.amount <= 0 THEN 'bank_transaction check amount' END,
            CASE WHEN d.currency <> 'USD' THEN 'bank_transaction check currency' END) AS violations
            FROM dirty d LEFT JOIN some_account s ON d.account_id = s.account_id""".replace(
                "d.amount * 100 AS cents", "CAST(d.amount * 100 AS BIGINT) AS cents"
            ),
            DIRTY_SQL,
        ),
    )(
        lambda s, f: Q.check_constraints(
            dirty(s, f)[0], "bank_transaction", "transaction_id", ["account_id", "amount"],
            {"account_id": dirty(s, f)[1]}, transaction_checks=True,
        ).select(
            "transaction_id", "account_id", (F.col("amount") * 100).cast("long").alias("cents"), "transaction_type",
            "currency", join_reasons(F.col("violations")).alias("violations"),
        )
    )
    reg.add(
        "dq_reconciled_files",
        f"""WITH {VALIDATED_SQL} SELECT source_file AS source_filename, COUNT(*) AS source_rows, COUNT(*) AS bronze_rows,
        COUNT(*) FILTER (error_reason = '') AS accepted_rows, COUNT(*) FILTER (error_reason <> '') AS rejected_rows,
        true AS reconciled FROM validated GROUP BY source_file""",
    )(
        lambda s, f: Q.reconcile_files(
            feed(s, f).groupBy(F.col("source_file").alias("source_filename")).agg(F.count("*").alias("source_rows")),
            validated(s, f).withColumnRenamed("source_file", "source_filename"),
        )
    )
    reg.add(
        "dq_join_completeness",
        "SELECT COUNT(*) AS input_rows, COUNT(*) AS summary_rows, true AS complete FROM lineitem",
    )(lambda s, f: Q.join_completeness(transactions(s, f), by_branch(transactions(s, f), accounts(s, f))))
    reg.add(
        "dq_totals_agree",
        with_roles(f"SELECT {dbl('SUM(amount)')} AS left_total, {dbl('SUM(amount)')} AS right_total, true AS agree FROM pay"),
    )(
        lambda s, f: Q.totals_agree(
            payments(s, f).groupBy("transaction_date").agg(F.sum("amount").alias("total")), "total",
            payments(s, f), "amount",
        )
    )
    reg.add(
        "dq_customer_rows",
        f"WITH {REF_SQL} SELECT source_row_number, customer_id, customer_name, customer_segment, reasons FROM cust_checked",
    )(
        lambda s, f: check_customers(customer_rows(s, f)).select(
            "source_row_number", "customer_id", "customer_name", "customer_segment",
            join_reasons(F.col("reasons")).alias("reasons"),
        )
    )
    reg.add(
        "dq_account_rows",
        f"WITH {ACC_SQL} SELECT source_row_number, account_id, customer_id, branch_id, account_type, account_status, reasons FROM acc_checked",
    )(
        lambda s, f: check_accounts(
            account_rows(s, f),
            table(s, f, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").cast("string").alias("customer_id")),
        ).select(
            "source_row_number", "account_id", "customer_id", "branch_id", "account_type", "account_status",
            join_reasons(F.col("reasons")).alias("reasons"),
        )
    )
    reg.add(
        "dq_silver_rows",
        f"WITH {SILVER_SQL} SELECT transaction_id, account_id, source_filename, source_row_number, customer_id, reasons FROM slv_checked",
    )(
        lambda s, f: check_silver(silver_rows(s, f), owner_map(s, f)).select(
            "transaction_id", "account_id", "source_filename", "source_row_number", "customer_id",
            join_reasons(F.col("reasons")).alias("reasons"),
        )
    )
    raw_sql = """'{"customer_id":"' || customer_id || '","customer_name":"' || customer_name || '","customer_segment":"' ||
        customer_segment || '"}'"""
    reg.add(
        "dq_exception_records",
        f"""WITH {REF_SQL}, raw AS (SELECT *, {raw_sql} AS raw_record FROM cust_checked WHERE reasons <> '')
        SELECT sha256(concat_ws(chr(31), 'CUSTOMER', 'customers.csv', CAST(source_row_number AS VARCHAR), raw_record, reasons)) AS exception_id,
        'CUSTOMER' AS entity_type, 'customers.csv' AS source_filename, source_row_number, customer_id,
        CAST(NULL AS VARCHAR) AS account_id, CAST(NULL AS VARCHAR) AS transaction_id, raw_record,
        reasons AS rejection_reasons FROM raw""",
    )(
        lambda s, f: exception_records(
            check_customers(customer_rows(s, f)), CUSTOMER, ["customer_id", "customer_name", "customer_segment"]
        ).drop("recorded_at")
    )

    def earlier(s, f):
        return silver_rows(s, f).filter((F.col("amount").isNull()) | (F.col("currency") == "")).select(
            "source_filename", "source_row_number", "transaction_id", "account_id",
            F.col("transaction_date").cast("string").alias("transaction_date"), "transaction_type",
            F.col("amount").cast("string").alias("amount"), "currency",
            F.when(F.col("currency") == "", " late ;; twice; ").otherwise("").alias("rejection_reasons"),
        )

    reg.add(
        "dq_imported_exceptions",
        f"""WITH {SILVER_SQL} SELECT 'TRANSACTION' AS entity_type, source_filename, source_row_number, customer_id,
        NULLIF(account_id, '') AS account_id, NULLIF(transaction_id, '') AS transaction_id,
        CASE WHEN currency = '' THEN 'late; twice' ELSE '{R.EARLIER_REJECTION}' END AS rejection_reasons
        FROM slv_checked WHERE amount IS NULL OR currency = ''""",
    )(
        lambda s, f: import_exceptions(earlier(s, f), owner_map(s, f)).drop("exception_id", "raw_record", "recorded_at")
    )
    reg.add(
        "dq_exceptions_by_entity",
        f"""WITH {REF_SQL}, {SILVER_SQL} SELECT 'CUSTOMER' AS entity_type, COUNT(*) AS exception_count FROM cust_checked WHERE reasons <> ''
        UNION ALL SELECT 'TRANSACTION', COUNT(*) FROM slv_checked WHERE amount IS NULL OR currency = ''""",
    )(
        lambda s, f: exceptions_by_entity(
            exception_records(check_customers(customer_rows(s, f)), CUSTOMER, ["customer_id"]).unionByName(
                import_exceptions(earlier(s, f), owner_map(s, f))
            )
        )
    )
    # names kept for completeness of the reference roles
    reg.add(
        "dq_orphan_accounts",
        with_roles("SELECT COUNT(*) AS bad FROM account WHERE customer_id NOT IN (SELECT customer_id FROM some_cust)", DIRTY_SQL),
    )(
        lambda s, f: Q.unmatched_rows(
            accounts(s, f),
            customers(s, f).join(
                table(s, f, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("customer_id")),
                "customer_id", "left_semi",
            ),
            "customer_id",
        )
    )
