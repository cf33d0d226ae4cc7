"""Ordered upsert with a stale guard."""

import random

import pytest
from fixtures import ACCOUNTS, FIRST_DAY, rows, transactions, write_lines
from pyspark.sql import functions as F

from ledgerloom.schemas import ACCOUNT, TRANSACTION_COLUMNS
from ledgerloom.sources.delimited import read_daily_files
from ledgerloom.sources.files import DAILY_FILE_GLOB, list_files
from ledgerloom.streaming.upsert import OUTCOMES, STATE, classify, flag_rows, merged, outcome_counts, stored_key

TEXT = ", ".join(f"{c} string" for c in TRANSACTION_COLUMNS) + ", source_file string, row_no long"


def stored(spark, data, file):
    return transactions(spark, data).withColumn("source_file", F.lit(file))


def empty_table(spark):
    return spark.createDataFrame(
        [], "transaction_id string, account_id string, transaction_date date, transaction_type string, "
        "amount decimal(18,2), currency string, source_file string")


def counts(classified):
    return {r.source_file: tuple(r[o] for o in OUTCOMES) for r in outcome_counts(classified).collect()}


def test_daily_files_and_rerun(spark, tmp_path):
    """Two daily files correct and add rows; the same files again change nothing, older ones are stale."""
    days = {"transactions_20310302.csv": [], "transactions_20310303.csv": []}
    rng, current = random.Random(2), {t[0]: t for t in FIRST_DAY}
    told = {}
    for name in days:
        inserted = updated = 0
        for i in range(8):
            known = rng.random() < 0.5
            tid = rng.choice(list(current)) if known else f"{name[-6:-4]}{i}"
            row = (tid, ACCOUNTS[rng.randrange(12)][0], "2031-03-02", rng.choice(("CREDIT", "DEBIT")), f"{rng.randrange(100, 900)}.25")
            inserted, updated = inserted + (tid not in current), updated + (tid in current)
            current[tid] = row
            days[name].append(",".join([*row, "USD"]))
        told[name] = (inserted, updated, 0, 0, 0)
        write_lines(tmp_path, name, days[name])
    (tmp_path / "notes.csv").write_text("x\n")
    daily = read_daily_files(spark, [r.path for r in list_files(spark, str(tmp_path), DAILY_FILE_GLOB).collect()])
    accounts = spark.createDataFrame(ACCOUNTS, ACCOUNT)
    target = stored(spark, FIRST_DAY, "a-first-day.csv")
    flagged = flag_rows(target, daily, accounts)
    assert counts(classify(target, daily, accounts)) == told
    table = merged(target, flagged).persist()
    assert sorted(rows(table.select(*TRANSACTION_COLUMNS[:5]))) == sorted((*r[:4], float(r[4])) for r in current.values())
    again = counts(classify(table, daily, accounts))
    assert all(c[0] == 0 and c[4] == 0 for c in again.values())
    assert sorted(rows(merged(table, flag_rows(table, daily, accounts)).select(table.columns))) == sorted(rows(table))
    table.unpersist()


def test_rejections(spark):
    accounts = spark.createDataFrame(ACCOUNTS, ACCOUNT)
    batch = spark.createDataFrame([
        ("T1", "P01", "9/1/2026", " credit ", " 10.005 ", "usd", "f1", 1),
        ("T2", "P01", "2026-09-01", "CREDIT", "x", "EUR", "f1", 2),
        ("T3", "P01", "2026-09-01", "PIZZA", "-1", "USD", "f1", 3),
        ("T4", "P01", "2026-09-01", "DEBIT", "0.004", "USD", "f1", 4),
        ("T5", "P01", "2026-09-01", "DEBIT", "1", "GBP", "f1", 5),
        ("T6", "P01", "2026-02-30", "DEBIT", "1", "USD", "f1", 6),
        ("T7", "P99", "2026-09-01", "DEBIT", "1", "USD", "f1", 7),
        (" ", "P01", "2026-09-01", "DEBIT", "1", "USD", "f1", 8),
    ], TEXT)
    got = {r.row_no: (r.outcome, r.reject_reason) for r in classify(empty_table(spark), batch, accounts).collect()}
    assert got[1] == ("inserted", None)
    assert [got[i][1] for i in range(2, 9)] == [
        "could not convert amount to a number", "Invalid transaction type", "Amount must be positive",
        "Unsupported currency", "Unrecognized date format", None, "transaction_id is missing"]
    assert all(got[i][0] == "rejected" for i in range(2, 9))


def brute_force(target, batch, accounts):
    """The same rules as a plain loop over the rows in order."""
    table, outcomes = dict(target), {}
    for row in sorted(batch, key=lambda r: (r[6], r[7])):
        tid, state = row[0], (row[1], row[2], row[3], float(row[4]), row[5], row[6])
        now = table.get(tid)
        if float(row[4]) <= 0:
            outcome = "rejected"
        elif now and row[6] < now[5]:
            outcome = "skipped_stale"
        elif row[1] not in accounts:
            outcome = "rejected"
        else:
            outcome = "inserted" if now is None else "unchanged" if now == state else "updated"
            table[tid] = state
        outcomes[(row[6], row[7])] = outcome
    return table, outcomes


@pytest.mark.parametrize("rows_per_chunk", [1_000_000, 4, 1])
def test_against_brute_force_with_a_hot_id(spark, rows_per_chunk):
    rng = random.Random(rows_per_chunk)
    ids = ["hot"] * 5 + [f"T{i}" for i in range(10)]
    batch = [
        (rng.choice(ids), rng.choice(["P01", "P02", "P99"]), f"2026-09-0{rng.randrange(1, 4)}",
         rng.choice(["CREDIT", "DEBIT"]), rng.choice(["1.00", "2.00", "0.00"]), "USD", f"f{1 + i // 60}", i % 60)
        for i in range(300)
    ]
    target = {t: ("P01", "2026-09-01", "CREDIT", 1.0, "USD", rng.choice(["f0", "f3", "f9"])) for t in set(ids) if rng.random() < 0.7}
    table, outcomes = brute_force(target, batch, {"P01", "P02"})
    stored_df = spark.createDataFrame(
        [(k, *v) for k, v in target.items()],
        "transaction_id string, account_id string, transaction_date string, transaction_type string, amount double, "
        "currency string, source_file string",
    ).withColumns({"transaction_date": F.col("transaction_date").cast("date"), "amount": F.col("amount").cast("decimal(18,2)")})
    batch_df = spark.createDataFrame(batch, TEXT).repartition(5)
    classified = classify(stored_df, batch_df, spark.createDataFrame(ACCOUNTS, ACCOUNT), rows_per_chunk)
    assert {(r.source_file, r.row_no): r.outcome for r in classified.collect()} == outcomes
    assert {r[0]: r[1:] for r in rows(merged(stored_df, classified).select("transaction_id", *STATE))} == table


def test_unreadable_rows_share_no_join_key(spark):
    """Rows that cannot meet a stored state are spread over many keys, and none of them meets one."""
    batch = spark.createDataFrame(
        [("K1" if i % 2 else "", "P01", "2031-03-02", "CREDIT", "x" if i % 2 else "1.00", "USD", "b.csv", i) for i in range(3000)]
        + [("K1", "P01", "2031-03-02", "CREDIT", "2.00", "USD", "b.csv", 3000)], TEXT)
    keyed = batch.withColumn("key", stored_key(F.col("row_no") == 3000))
    assert keyed.select("key").distinct().count() > 500
    assert [r.key for r in keyed.filter("row_no = 3000").collect()] == ["K1"]
    target = stored(spark, [("K1", "P01", "2031-03-01", "CREDIT", "1.00")], "a.csv")
    flagged = flag_rows(target, batch, spark.createDataFrame(ACCOUNTS, ACCOUNT)).select("row_no", "stored", "stale", "writes")
    assert flagged.filter("row_no < 3000").filter("stored IS NOT NULL OR stale OR writes").count() == 0
    assert [(r.stored is not None, r.writes) for r in flagged.filter("row_no = 3000").collect()] == [(True, True)]
    assert flagged.count() == 3001
