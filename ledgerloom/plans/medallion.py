"""Landing folder -> bronze -> silver and exceptions -> gold, one run at a time.

Every step is set-based and lazy up to its write. Bronze, silver, exceptions, the accepted ids and the
run's part of gold are partitioned by run; they count from the moment the run's commit exists, so a run
that stops half-way leaves nothing behind that a later run would see. A commit takes the next number
after the one that was the last when the run began. If another run has taken it, this run fails whole:
it has judged ids and files without knowing the other's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.money import is_beyond_money
from ledgerloom.functions.text import (
    broken_mask,
    fingerprint,
    is_missing,
    join_reasons,
    masked_reasons,
)
from ledgerloom.operators.aggregates import branch_daily_summary
from ledgerloom.operators.joins import with_unknown_flag
from ledgerloom.operators.quality import assert_reconciled, reconcile_files
from ledgerloom.operators.rules import ALREADY_ACCEPTED, BEYOND_MONEY, UNKNOWN_ACCOUNT, value_rules
from ledgerloom.operators.sets import same_rows
from ledgerloom.operators.transforms import typed_silver, with_run_lineage
from ledgerloom.schemas import (
    BRONZE,
    EXCEPTIONS,
    GOLD,
    GOLD_PART,
    SILVER,
    TOTAL,
    TRANSACTION_COLUMNS,
)
from ledgerloom.session import TEXT_CODEC, materialize
from ledgerloom.sinks import audit
from ledgerloom.sinks.commits import CommitConflict, CommitLog
from ledgerloom.sinks.publish import publish, read_current, read_or_empty
from ledgerloom.sources.delimited import file_faults, strict_rows
from ledgerloom.sources.files import HASHED, HASHED_COLUMNS, branch_of, discover
from ledgerloom.sources.tables import account_ids
from ledgerloom.streaming.dedup import Places, first_accepted_wins
from ledgerloom.streaming.id_index import IdIndex
from ledgerloom.streaming.idempotency import (
    LOADED,
    PROCESSED,
    SKIPPED,
    current_files,
    loaded_in_run,
    with_prior_copy,
)

RESULTS = "source_filename string, source_rows long, bronze_rows long, accepted_rows long, rejected_rows long, reconciled boolean"
ORDER = ["file_date", "branch_id", "source_filename", "source_row_number"]

GOLD_SQL = """
SELECT branch_id, transaction_date, transaction_type,
       COUNT(*) AS transaction_count, SUM(amount) AS total_amount
FROM {silver} GROUP BY ALL
"""


@dataclass(frozen=True)
class Store:
    """Where the tables of one medallion live."""

    spark: SparkSession
    base: str

    def _at(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"

    @property
    def run_log(self) -> str:
        return self._at("run_events")

    @property
    def file_log(self) -> str:
        return self._at("file_events")

    @property
    def gold_home(self) -> str:
        return self._at("gold")

    def run_events(self) -> DataFrame:
        return audit.run_events(self.spark, self.run_log)

    def run_audit(self) -> DataFrame:
        return audit.run_audit(self.run_events())

    @property
    def commits(self) -> CommitLog:
        return CommitLog(self.spark, self._at("_commits"))

    @property
    def accepted_ids(self) -> IdIndex:
        return IdIndex(self.spark, self._at("accepted_ids"))

    def committed_runs(self) -> DataFrame:
        return self.commits.entries("run_id string").distinct()

    def discover(self, landing: str) -> DataFrame:
        """Manifest of a landing folder; only files that are new or changed since an earlier run are opened."""
        known = read_or_empty(self.spark, self._at("known_files"), self.spark.createDataFrame([], HASHED).schema)
        manifest = materialize(discover(self.spark, landing, known), "manifest")
        fresh = manifest.select(*HASHED_COLUMNS).join(known, HASHED_COLUMNS, "left_anti")
        fresh.coalesce(1).write.mode("append").parquet(self._at("known_files"))
        return manifest.drop("length", "modified")

    def logged_events(self) -> DataFrame:
        """The file log as written, also what runs without a commit have written."""
        return audit.file_events(self.spark, self.file_log)

    def file_events(self) -> DataFrame:
        """Events of the file log; PROCESSED ones count for committed runs only."""
        events = self.logged_events()
        done = events.filter(F.col("file_status") == PROCESSED).join(self.committed_runs(), "run_id", "left_semi")
        return events.filter(F.col("file_status") != PROCESSED).unionByName(done)

    def file_audit(self) -> DataFrame:
        return current_files(self.file_events())

    def bronze(self) -> DataFrame:
        """Rows of files that reached LOADED."""
        loaded = self.logged_events().filter(F.col("file_status") == LOADED).select("run_id", "source_filename")
        rows = read_or_empty(self.spark, self._at("bronze"), BRONZE)
        return rows.join(loaded.distinct(), ["run_id", "source_filename"], "left_semi")

    def _committed(self, name: str, schema) -> DataFrame:
        held = read_or_empty(self.spark, self._at(name), schema)
        return held.join(self.committed_runs(), "run_id", "left_semi").select(*schema.fieldNames())

    def silver(self) -> DataFrame:
        return self._committed("silver", SILVER)

    def exceptions(self) -> DataFrame:
        return self._committed("exceptions", EXCEPTIONS)

    def gold_parts(self) -> DataFrame:
        """Counts and totals that each run adds to gold."""
        return self._committed("gold_parts", GOLD_PART)

    def gold(self) -> DataFrame:
        return read_current(self.spark, self.gold_home)

    def write_rows(self, df: DataFrame, name: str, schema) -> None:
        shaped = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        shaped.write.mode("append").partitionBy("run_id").parquet(self._at(name), compression=TEXT_CODEC)


def bronze_id(run_id: str) -> Column:
    """Id of a bronze row: it follows from its place, so steps between the tables need not carry it."""
    return fingerprint(F.lit(run_id), F.col("source_filename"), F.col("source_row_number").cast("string"))


def ingest(store: Store, run_id: str, recognized: DataFrame) -> DataFrame:
    """Load new files into bronze as received; returns this run's files with status and rows.

    The first faulty file in delivery order stops the step; files before it stay loaded.
    """
    files = materialize(with_prior_copy(recognized, store.file_events()), "files")
    new = files.filter(F.col("file_status") == LOADED)
    paths = [r.path for r in new.select("path").collect()]
    skipped = files.filter(F.col("file_status") == SKIPPED).withColumn("source_rows", F.lit(0).cast("long"))
    if not paths:
        audit.append_file_events(_file_log_rows(skipped, run_id), store.file_log)
        return skipped
    rows, findings = strict_rows(store.spark, paths)
    order = F.struct("file_date", "branch_id", "filename")
    checked = materialize(file_faults(new, findings), "findings")
    fault = checked.filter(F.col("error").isNotNull()).agg(F.min(F.struct(order.alias("place"), "error")).alias("f")).first().f
    if fault is not None:
        stop = F.struct(
            F.lit(fault.place.file_date).alias("file_date"),
            F.lit(fault.place.branch_id).alias("branch_id"),
            F.lit(fault.place.filename).alias("filename"),
        )
        checked = checked.filter(order < stop)
        skipped = skipped.filter(order < stop)
    bronze = rows.join(checked.select(F.col("filename").alias("source_filename")), "source_filename", "left_semi")
    bronze = with_run_lineage(bronze, run_id, F.lit(audit.utc_now())).withColumns(
        {
            "branch_id": branch_of(F.col("source_filename")),
            "bronze_id": bronze_id(run_id),
        }
    )
    store.write_rows(bronze, "bronze", BRONZE)
    done = checked.drop("error").unionByName(skipped)
    audit.append_file_events(_file_log_rows(done, run_id), store.file_log)
    if fault is not None:
        raise ValueError(fault.error)
    return done


def _file_log_rows(files: DataFrame, run_id: str) -> DataFrame:
    none = F.when(F.col("file_status") == SKIPPED, F.lit(0)).cast("long")
    return files.select(
        F.lit(run_id).alias("run_id"),
        F.col("filename").alias("source_filename"),
        "branch_id", "file_date",
        F.col("sha256").alias("file_sha256"),
        "source_rows",
        none.alias("accepted_rows"), none.alias("rejected_rows"),
        "file_status", "note",
    )


def judge(
    bronze: DataFrame, accounts: DataFrame, accepted_before: DataFrame | None = None, keep: list[str] | None = None
) -> DataFrame:
    """All eight rules per row: adds ``reasons`` and ``is_valid``.

    An amount that is right but that silver's type cannot hold has a reason of its own.

    ``bronze`` has the text columns, file_date and the lineage columns of :data:`ORDER`. ``keep`` names those of its
    columns that the result has, by default all: what is not asked for is judged where it is read and never moved.
    """
    keep, places = bronze.columns if keep is None else keep, Places(bronze, ORDER)
    rules = [*value_rules(), (BEYOND_MONEY, is_beyond_money(F.col("amount")))]
    moved = dict.fromkeys([*keep, "transaction_id", "account_id", *ORDER])
    rows = places.pack(bronze.withColumn("mask", broken_mask(rules)).select(*moved, "mask"), "place")
    flagged = with_unknown_flag(rows, account_ids(accounts), "account_id", "unknown_account", bronze)
    unknown = ~is_missing(F.col("account_id")) & F.col("unknown_account")
    flagged = flagged.withColumn("mask", F.col("mask") + F.when(unknown, 1 << len(rules)).otherwise(0)).drop("unknown_account")
    # judged once: the rows that find the winners and the rows that get the verdict are the same
    flagged = flagged if "account_id" in keep else flagged.drop("account_id")
    flagged = materialize(flagged, "judged", TEXT_CODEC)
    flagged = first_accepted_wins(
        flagged, "transaction_id", F.col("mask") == 0, ["place"], "repeated", accepted_before
    )
    # the repeat is the last rule, and only rows with an id can break it
    texts = [*[text for text, _ in rules], UNKNOWN_ACCOUNT, ALREADY_ACCEPTED]
    flagged = flagged.withColumn("mask", F.col("mask") + F.when(F.col("repeated"), 1 << (len(texts) - 1)).otherwise(0))
    flagged = places.unpack(flagged, "place")
    return flagged.withColumns(
        {"reasons": masked_reasons(F.col("mask"), texts), "is_valid": F.col("mask") == 0}
    ).select(*keep, "reasons", "is_valid")


def validate(store: Store, run_id: str, accounts: DataFrame, seen: int | None = None) -> DataFrame:
    """Bronze rows of this run -> silver and exceptions; all or nothing. Returns the file results.

    ``seen`` is the number of the last commit when the run began, by default the present one.
    """
    seen = store.commits.version() if seen is None else seen
    files = materialize(loaded_in_run(store.logged_events(), run_id), "pending")
    if files.isEmpty():
        return store.spark.createDataFrame([], RESULTS)
    rows = store.bronze().filter(F.col("run_id") == run_id).join(
        files.select("source_filename", "file_date"), "source_filename"
    ).drop("bronze_id", "run_id", "load_timestamp")
    before = store.accepted_ids.seen(rows.select("transaction_id"), store.committed_runs()).withColumnRenamed("id", "transaction_id")
    checked = materialize(judge(rows, accounts, before), "checked", TEXT_CODEC)
    results = materialize(reconcile_files(files.select("source_filename", "source_rows"), checked), "results")
    assert_reconciled(results)
    named = {"run_id": F.lit(run_id), "bronze_id": bronze_id(run_id)}
    accepted = typed_silver(checked.filter("is_valid"))
    store.write_rows(accepted.withColumns(named), "silver", SILVER)
    store.write_rows(branch_daily_summary(accepted).withColumn("run_id", F.lit(run_id)), "gold_parts", GOLD_PART)
    store.accepted_ids.add(run_id, accepted.select("transaction_id"))
    rejected = checked.filter(~F.col("is_valid")).withColumns(named).withColumns(
        {
            "rejection_reasons": join_reasons(F.col("reasons")),
            "exception_id": fingerprint(F.lit("exception"), F.col("bronze_id")),
        }
    )
    store.write_rows(rejected, "exceptions", EXCEPTIONS)
    counts = results.select("source_filename", "accepted_rows", "rejected_rows")
    events = (
        files.drop("accepted_rows", "rejected_rows", "event_ts")
        .join(counts, "source_filename")
        .withColumn("file_status", F.lit(PROCESSED))
    )
    audit.append_file_events(events, store.file_log)
    store.commits.commit(seen, {"run_id": run_id})
    return results


def gold_with_dataframe(silver: DataFrame) -> DataFrame:
    return branch_daily_summary(silver)


def gold_from_parts(parts: DataFrame) -> DataFrame:
    """Gold from what each run adds to it: counts and exact totals add up."""
    return parts.groupBy("branch_id", "transaction_date", "transaction_type").agg(
        F.sum("transaction_count").alias("transaction_count"), F.sum("total_amount").cast(TOTAL).alias("total_amount")
    )


def gold_with_sql(silver: DataFrame) -> DataFrame:
    return silver.sparkSession.sql(GOLD_SQL, silver=silver)


def transform(silver: DataFrame, first=gold_with_dataframe, second=gold_with_sql) -> DataFrame:
    """Gold computed in two ways; a difference is an error. Empty silver, empty gold.

    The results meet as fingerprints. A run of :func:`run_medallion` adds up the runs' parts as the first way,
    so all of silver is read once, by the second.
    """
    gold, again = materialize(first(silver), "gold"), second(silver)
    if not same_rows(gold, again):
        raise ValueError("PySpark and SQL Gold results differ")
    return gold


def publish_gold(store: Store, run_id: str, gold: DataFrame) -> int:
    """Replace the published gold and its CSV; returns its rows."""
    shaped = gold.select(*[F.col(f.name).cast(f.dataType) for f in GOLD.fields])
    return publish(
        shaped.withColumn("published_run_id", F.lit(run_id)),
        store.gold_home,
        run_id,
        required=GOLD.fieldNames(),
        order=["branch_id", "transaction_date", "transaction_type"],
        export=shaped,
    )


def run_summary(ingested: DataFrame, results: DataFrame, unrecognized: int, gold_rows: int) -> str:
    """Text of a successful run."""
    files = ingested.agg(
        F.count_if(F.col("file_status") == LOADED).alias("loaded"),
        F.count_if(F.col("file_status") == SKIPPED).alias("skipped"),
    ).first()
    rows = results.agg(
        F.coalesce(F.sum("accepted_rows"), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum("rejected_rows"), F.lit(0)).alias("rejected"),
    ).first()
    return (
        f"files loaded={files.loaded}, skipped_identical={files.skipped}, unrecognized={unrecognized}; "
        f"accepted={rows.accepted}, rejected={rows.rejected}; gold_rows={gold_rows}"
    )


def run_medallion(spark: SparkSession, landing: str, base: str, accounts: DataFrame, attempts: int = 1) -> dict:
    """All steps once. Never raises after the start: the result names a failing step.

    A run that another run has overtaken fails at validate; with ``attempts`` above 1 it starts again as a new run,
    which finds the other's files and ids.
    """
    for attempt in range(attempts):
        result, overtaken = _run_once(spark, landing, base, accounts)
        if not overtaken or attempt == attempts - 1:
            return result


def _run_once(spark: SparkSession, landing: str, base: str, accounts: DataFrame) -> tuple[dict, bool]:
    store = Store(spark, base)
    run_id, seen, overtaken = audit.new_run_id(), store.commits.version(), False
    audit.append_run_event(spark, store.run_log, run_id, audit.RUNNING)
    result = {"run_id": run_id, "gold_rows": 0, "unrecognized": None}
    step = "discover"
    try:
        manifest = store.discover(landing)
        unrecognized = manifest.filter(F.col("reason").isNotNull()).select("filename", "reason")
        result["unrecognized"] = unrecognized
        step = "ingest"
        ingested = ingest(store, run_id, manifest.filter(F.col("reason").isNull()).drop("reason"))
        step = "validate"
        results = validate(store, run_id, accounts, seen)
        # gold follows the commits: if another run commits meanwhile, it is computed again from both
        while True:
            step, version = "transform", store.commits.version()
            gold = transform(store.silver(), first=lambda _: gold_from_parts(store.gold_parts()))
            step = "publish"
            if store.commits.version() == version:
                break
        result["gold_rows"] = publish_gold(store, run_id, gold)
        result["status"] = audit.SUCCESS
        result["reason"] = run_summary(ingested, results, unrecognized.count(), result["gold_rows"])
    except Exception as error:
        overtaken = isinstance(error, CommitConflict)
        result["status"] = audit.FAILED
        result["reason"] = f"{step} failed: {type(error).__name__}: {error}"
    audit.append_run_event(spark, store.run_log, run_id, result["status"], result["reason"])
    return result, overtaken
