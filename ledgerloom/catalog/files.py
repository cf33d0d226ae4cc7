"""Registered sources and sinks: the untidy feed is written out as delivered files and read back.

Files are written by Spark below the shared folder. One delivered file is one sequential text, so
one task writes it; its rows are sorted by as many tasks as they need.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog.feed import FEED_SQL, feed
from ledgerloom.catalog.quality import ACC_SQL, REF_SQL, account_rows, customer_rows
from ledgerloom.catalog.roles import dbl, frames, payments, table, with_roles
from ledgerloom.catalog.reports import NET
from ledgerloom.catalog.state import DAILY_SQL, JUDGED_SQL, daily_batch
from ledgerloom.functions.text import join_reasons
from ledgerloom.operators.transforms import at_edge
from ledgerloom.plans.branch_report import branch_summary
from ledgerloom.plans.customer_summary import check_customers
from ledgerloom.plans.delivery import check_delivery
from ledgerloom.plans.medallion import Store, run_medallion
from ledgerloom.schemas import TRANSACTION_COLUMNS
from ledgerloom.session import materialize, scratch_path
from ledgerloom.sinks.publish import CSV_FORMAT, current_csv, publish, read_current, write_checked_parquet, write_csv
from ledgerloom.sinks.reports import write_branch_report, write_split
from ledgerloom.sources.branch_files import file_report, read_branch_files
from ledgerloom.sources.delimited import (
    file_faults,
    read_daily_files,
    read_reference_csv,
    strict_rows,
)
from ledgerloom.sources.files import DAILY_FILE_GLOB, discover, list_files, path_texts
from ledgerloom.sources.tables import account_ids, load_csv, load_table, load_typed_csv, register_views
from ledgerloom.schemas import ACCOUNT, TYPED_TRANSACTION


# rows that one task sorts, and the rows of a file that is sorted by several tasks
ROWS_PER_TASK = 500_000
LARGE_FILE_ROWS = 1_000_000

# tasks move the files they wrote; the other way the driver moves all, one after the other. The folder is read
# after the job alone, and an attempt writes the same files as the one before it
COMMIT_BY_TASKS = ("mapreduce.fileoutputcommitter.algorithm.version", "2")
RENAMES_AT_ONCE = 8


def deliver(df: DataFrame, name: str, order: list[str], columns: list[str], large_file_rows: int = LARGE_FILE_ROWS) -> str:
    """Write rows as CSV files named by column ``name``; returns the folder.

    Spark names its own part files, so each is moved to the delivered name afterwards. No task sorts the rows
    of a file longer than ``large_file_rows``, see :func:`_large_files`.
    """
    spark = df.sparkSession
    staged, landing = scratch_path(spark, "staged"), scratch_path(spark, "landing")
    counts = materialize(df.groupBy(F.col(name).alias("file")).agg(F.count("*").alias("rows")), "delivered-files")
    is_large = F.col("file").isNotNull() & (F.col("rows") > large_file_rows)
    large = {r.file: r.rows for r in counts.filter(is_large).orderBy("file").collect()}
    rest = counts.filter(~is_large).agg(F.count("*").alias("files"), F.sum("rows").alias("rows")).first()
    folders = []
    if rest.files or not large:
        tasks = max(-(-(rest.rows or 1) // ROWS_PER_TASK), min(rest.files, spark.sparkContext.defaultParallelism), 1)
        small = df.filter(~F.coalesce(F.col(name).isin(list(large)), F.lit(False))) if large else df
        (
            small.repartition(tasks, name)
            .sortWithinPartitions(name, *order)
            .select(F.col(name).alias("delivered"), *columns)
            .write.partitionBy("delivered")
            .option(*COMMIT_BY_TASKS)
            .csv(staged, header=True, **CSV_FORMAT)
        )
        folders.append(staged)
    if large:
        folders.append(f"{staged}-large")
        _large_files(df, name, order, columns, large).write.partitionBy("delivered").text(folders[-1])
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path(landing))

    def move(part: str) -> None:
        title, name = part.rsplit("/", 2)[1:]
        if title.startswith("delivered=") and name.endswith((".csv", ".txt")):
            store.rename(path(part), path(f"{landing}/{title.removeprefix('delivered=')}"))

    with ThreadPoolExecutor(RENAMES_AT_ONCE) as pool:
        for at in folders:
            titles = spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(store.listStatus(path(at)))
            list(pool.map(move, path_texts(spark, store.listStatus(titles))))
    return landing


def _large_files(df: DataFrame, name: str, order: list[str], columns: list[str], rows: dict[str, int]) -> DataFrame:
    """Text of the files named in ``rows``, one task a file, in order: (delivered, text).

    One task has to write a file, but not to sort its rows: ranges of them are sorted in many tasks and joined to
    texts of some thousand lines, so the last task orders a few thousand texts.
    """

    def joined(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        seq = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column("delivered"))
            ends = runs.run_ends.to_pylist()
            lines = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), batch.column("line"))
            numbers = pa.array(range(seq, seq + len(ends)), pa.int64())
            seq += len(ends)
            part = pa.array(batch.column("part").to_numpy()[[e - 1 for e in ends]], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [runs.values, part, numbers, pc.binary_join(lines, "\n")], names=["delivered", "part", "seq", "text"]
            )

    files = list(rows)
    # most lines need no quotes, and joining their values is far cheaper than the CSV generator
    bare = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    plain = rf"^[A-Za-z0-9 _./-]*(?:\x01[A-Za-z0-9 _./-]*){{{len(columns) - 1}}}\z"
    texts = (
        df.filter(F.col(name).isin(files))
        .repartitionByRange(-(-sum(rows.values()) // ROWS_PER_TASK), name, *order)
        .sortWithinPartitions(name, *order)
        .select(
            F.col(name).alias("delivered"),
            F.spark_partition_id().alias("part"),
            F.when((bare != "") & bare.rlike(plain), F.translate(bare, "\x01", ","))
            .otherwise(F.coalesce(F.to_csv(F.struct(*columns), CSV_FORMAT), F.lit("")))
            .alias("line"),
        )
        .mapInArrow(joined, "delivered string, part int, seq long, text string")
    )
    head = df.sparkSession.createDataFrame([(f, -1, 0, ",".join(columns)) for f in files], texts.schema)
    number = F.array_position(F.array(*[F.lit(f) for f in files]), F.col("delivered")) - 1
    placed = head.unionByName(texts).repartitionById(len(files), number.cast("int"))
    return placed.sortWithinPartitions("delivered", "part", "seq").select("delivered", "text")


def branch_landing(spark: SparkSession, folder: str) -> str:
    """The feed as branch files."""
    return deliver(feed(spark, folder), "source_file", ["place"], TRANSACTION_COLUMNS)


def one_file(df: DataFrame, title: str, order: list[str], columns: list[str]) -> str:
    named = df.withColumn("__file", F.lit(title))
    return f"{deliver(named, '__file', order, columns)}/{title}"


def paths_of(files: DataFrame) -> list[str]:
    return [r.path for r in files.select("path").collect()]


NUMBERED = """numbered AS (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY source_file ORDER BY place) AS row_number FROM feed)"""

SIX = "transaction_id, account_id, transaction_date, transaction_type, amount, currency"

CONTENT_SQL = f"""content AS (
    SELECT source_file, branch_id, file_date, '{",".join(TRANSACTION_COLUMNS)}' || chr(10) || string_agg(
        concat_ws(',', {SIX}), chr(10) ORDER BY place) || chr(10) AS body
    FROM feed GROUP BY source_file, branch_id, file_date)"""


def register(reg) -> None:
    @reg.add(
        "s_file_manifest",
        f"WITH {FEED_SQL} SELECT DISTINCT source_file AS filename, branch_id, CAST(file_date AS VARCHAR) AS file_date, "
        "CAST(NULL AS VARCHAR) AS reason FROM feed",
    )
    def _(s, f):
        return discover(s, branch_landing(s, f)).select("filename", "branch_id", "file_date", "reason")

    @reg.add("s_file_hashes", f"WITH {FEED_SQL}, {CONTENT_SQL} SELECT source_file AS filename, sha256(body) AS sha256 FROM content")
    def _(s, f):
        return discover(s, branch_landing(s, f)).select("filename", "sha256")

    @reg.add(
        "s_branch_rows",
        f"""WITH {FEED_SQL} SELECT NULLIF(transaction_id, '') AS transaction_id, account_id, transaction_date,
        transaction_type, NULLIF(amount, '') AS amount, currency, source_file FROM feed""",
    )
    def _(s, f):
        return read_branch_files(s, branch_landing(s, f))[0]

    @reg.add(
        "s_branch_file_report",
        f"WITH {FEED_SQL} SELECT DISTINCT source_file AS file, '{','.join(TRANSACTION_COLUMNS)}' AS header, "
        "false AS open_quotes, CAST(NULL AS VARCHAR) AS error FROM feed",
    )
    def _(s, f):
        return file_report(s, branch_landing(s, f)).drop("path")

    @reg.add(
        "s_strict_rows",
        f"WITH {FEED_SQL}, {NUMBERED} SELECT source_file AS source_filename, row_number AS source_row_number, {SIX} FROM numbered",
    )
    def _(s, f):
        return strict_rows(s, paths_of(list_files(s, branch_landing(s, f))))[0]

    @reg.add(
        "s_strict_findings",
        f"""WITH {FEED_SQL} SELECT source_file AS filename, COUNT(*) AS source_rows, CAST(NULL AS VARCHAR) AS error
        FROM feed GROUP BY source_file""",
    )
    def _(s, f):
        files = list_files(s, branch_landing(s, f))
        return file_faults(files, strict_rows(s, paths_of(files))[1]).select("filename", "source_rows", "error")

    @reg.add(
        "s_reference_rows",
        f"""WITH {REF_SQL} SELECT 1 + ROW_NUMBER() OVER (ORDER BY source_row_number) AS source_row_number, customer_id,
        customer_name, customer_segment, reasons FROM cust_checked""",
    )
    def _(s, f):
        columns = ["customer_id", "customer_name", "customer_segment"]
        path = one_file(customer_rows(s, f), "customers.csv", ["source_row_number"], columns)
        return check_customers(read_reference_csv(s, path, columns)).select(
            "source_row_number", *columns, join_reasons(F.col("reasons")).alias("reasons")
        )

    @reg.add(
        "s_daily_rows",
        f"""WITH {DAILY_SQL} SELECT source_file, ROW_NUMBER() OVER (PARTITION BY source_file ORDER BY row_no) AS row_no,
        transaction_id FROM (SELECT * REPLACE ('transactions_' || year(d) || '.csv' AS source_file,
            CASE WHEN no_id THEN '' ELSE ' ' || transaction_id END AS transaction_id) FROM daily)""",
    )
    def _(s, f):
        rows = daily_batch(s, f).withColumn("source_file", F.regexp_replace("source_file", r"[0-9]{4}\.csv$", ".csv"))
        landing = deliver(rows, "source_file", ["row_no"], TRANSACTION_COLUMNS)
        return read_daily_files(s, paths_of(list_files(s, landing, DAILY_FILE_GLOB))).select(
            "source_file", "row_no", "transaction_id"
        )

    @reg.add(
        "s_account_csv",
        f"WITH {ACC_SQL} SELECT account_id, customer_id, NULLIF(branch_id, '') AS branch_id, "
        "NULLIF(account_type, '') AS account_type, account_status FROM acc_rows",
    )
    def _(s, f):
        path = scratch_path(s, "accounts")
        write_csv(account_rows(s, f).select("account_status", *ACCOUNT.fieldNames()[:4]), path)
        return load_csv(s, path, ACCOUNT)

    @reg.add(
        "s_typed_csv",
        with_roles(
            f"""SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, CAST(account_id AS VARCHAR) AS account_id,
            CAST(transaction_date AS VARCHAR) AS transaction_date, transaction_type, {dbl('amount')} AS amount, currency FROM pay"""
        ),
    )
    def _(s, f):
        path = scratch_path(s, "typed")
        write_csv(payments(s, f).select(*TRANSACTION_COLUMNS), path)
        return load_typed_csv(s, path, TYPED_TRANSACTION)

    @reg.add("s_views", "SELECT n_name, COUNT(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
    def _(s, f):
        register_views({name: table(s, f, name) for name in ("customer", "nation")})
        return s.sql("SELECT n_name, COUNT(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")

    @reg.add(
        "s_account_id_file",
        "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS account_id FROM lineitem",
    )
    def _(s, f):
        path = scratch_path(s, "ids")
        write_csv(account_rows(s, f).select("account_id", "account_type"), path)
        return account_ids(s.read.csv(path, header=True))

    # sinks
    @reg.add(
        "k_published_gold",
        with_roles(
            f"""SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, transaction_type,
            COUNT(*) AS transaction_count, {dbl('SUM(amount)')} AS total_amount FROM pay GROUP BY ALL"""
        ),
    )
    def _(s, f):
        base = scratch_path(s, "gold")
        gold = payments(s, f).groupBy("transaction_date", "transaction_type").agg(
            F.count("*").alias("transaction_count"), F.sum("amount").alias("total_amount")
        )
        publish(gold.limit(0), base, "v1", gold.columns)
        publish(gold, base, "v2", gold.columns, ["transaction_date", "transaction_type"])
        return read_current(s, base)

    @reg.add(
        "k_published_csv",
        with_roles(
            """SELECT CAST(transaction_date AS VARCHAR) AS transaction_date, CAST(COUNT(*) AS VARCHAR) AS n FROM pay GROUP BY 1"""
        ),
    )
    def _(s, f):
        base = scratch_path(s, "csv")
        days = payments(s, f).groupBy("transaction_date").agg(F.count("*").alias("n"))
        publish(days, base, "v1", order=["transaction_date"])
        return s.read.csv(current_csv(s, base), header=True)

    @reg.add(
        "k_branch_report",
        with_roles(
            f"""SELECT CAST(a.branch_id AS VARCHAR) AS branch_id, CAST(COUNT(*) AS VARCHAR) AS transaction_count,
            {dbl('SUM(amount)')} AS gross_amount, {dbl(NET)} AS net_cash_flow
            FROM tx t JOIN account a ON t.account_id = a.account_id GROUP BY a.branch_id"""
        ),
    )
    def _(s, f):
        done = write_branch_report(branch_summary(frames(s, f)), scratch_path(s, "report"))
        return s.read.csv(done["path"], header=True).withColumns(
            {c: F.col(c).cast("double") for c in ("gross_amount", "net_cash_flow")}
        )

    @reg.add(
        "k_checked_parquet",
        with_roles(f"SELECT transaction_id, account_id, transaction_type, {dbl('amount')} AS amount FROM tx"),
    )
    def _(s, f):
        base = scratch_path(s, "tables")
        rows = frames(s, f).tx.select("transaction_id", "account_id", "transaction_type", "amount")
        write_checked_parquet(rows, f"{base}/tx")
        return load_table(s, base, "tx")

    @reg.add(
        "k_invalid_output",
        f"""WITH {FEED_SQL}, counted AS (SELECT *, COUNT(*) OVER (PARTITION BY transaction_id) AS copies FROM ruled)
        SELECT source_file, NULLIF(transaction_id, '') AS transaction_id,
            concat_ws('; ', NULLIF(value_reasons, ''), CASE WHEN copies > 1 AND transaction_id <> ''
                THEN 'duplicate transaction_id across combined branch data' END) AS error_reason
        FROM counted WHERE value_reasons <> '' OR (copies > 1 AND transaction_id <> '')""",
    )
    def _(s, f):
        delivery, base = check_delivery(s, branch_landing(s, f)), scratch_path(s, "split")
        write_split(delivery.validated, base)
        return s.read.csv(f"{base}/invalid_transactions.csv", header=True, quote='"', escape='"').select(
            "source_file", "transaction_id", "error_reason"
        )

    # the whole landing-to-gold run, seen from each of its tables
    def medallion(s, f):
        from ledgerloom.catalog.feed import known_accounts

        store = Store(s, scratch_path(s, "medallion"))
        result = run_medallion(s, branch_landing(s, f), store.base, materialize(known_accounts(s, f), "known"))
        if result["status"] != "SUCCESS":
            raise RuntimeError(result["reason"])
        return store

    @reg.add(
        "medallion_gold",
        f"""WITH {JUDGED_SQL} SELECT branch_id, transaction_date, transaction_type, COUNT(*) AS transaction_count,
        {dbl('SUM(CAST(amount AS DECIMAL(18,2)))')} AS total_amount FROM judged WHERE reasons = '' GROUP BY ALL""",
    )
    def _(s, f):
        return medallion(s, f).gold().drop("published_run_id")

    @reg.add(
        "medallion_file_audit",
        f"""WITH {JUDGED_SQL} SELECT source_file AS source_filename, branch_id, CAST(file_date AS VARCHAR) AS file_date,
        COUNT(*) AS source_rows, COUNT(*) FILTER (reasons = '') AS accepted_rows,
        COUNT(*) FILTER (reasons <> '') AS rejected_rows, 'PROCESSED' AS file_status FROM judged GROUP BY ALL""",
    )
    def _(s, f):
        return medallion(s, f).file_audit().select(
            "source_filename", "branch_id", "file_date", "source_rows", "accepted_rows", "rejected_rows", "file_status"
        )

    @reg.add(
        "medallion_exceptions",
        f"""WITH {JUDGED_SQL}, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_file ORDER BY place) AS row_number FROM judged)
        SELECT source_file AS source_filename, row_number AS source_row_number, transaction_id, account_id, amount,
        reasons AS rejection_reasons FROM n WHERE reasons <> ''""",
    )
    def _(s, f):
        return medallion(s, f).exceptions().select(
            "source_filename", "source_row_number", "transaction_id", "account_id", "amount", "rejection_reasons"
        )

    @reg.add(
        "medallion_silver",
        f"""WITH {JUDGED_SQL}, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_file ORDER BY place) AS row_number FROM judged)
        SELECT source_file AS source_filename, row_number AS source_row_number, transaction_id, account_id, branch_id,
        transaction_date, transaction_type, {dbl('CAST(amount AS DECIMAL(18,2))')} AS amount, currency FROM n WHERE reasons = ''""",
    )
    def _(s, f):
        return at_edge(
            medallion(s, f).silver().select(
                "source_filename", "source_row_number", "transaction_id", "account_id", "branch_id",
                "transaction_date", "transaction_type", "amount", "currency",
            )
        )

