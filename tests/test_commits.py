"""Commits, tables published together, keyed tables, the id index and fingerprints."""

import random

import pytest
from fixtures import ACCOUNTS, branch_files, write_lines
from pyspark.sql import functions as F

from ledgerloom.operators import sets
from ledgerloom.plans import analytical, medallion
from ledgerloom.plans.medallion import Store, run_medallion
from ledgerloom.schemas import ACCOUNT
from ledgerloom.sinks.commits import CommitConflict, CommitLog
from ledgerloom.sinks.together import publish_together, read_together
from ledgerloom.streaming import upsert
from ledgerloom.streaming.id_index import IdIndex
from ledgerloom.streaming.keyed_table import KeyedTable

# --- commits ---


def test_a_number_is_taken_once(spark, tmp_path):
    log, other = (CommitLog(spark, str(tmp_path / "log")) for _ in range(2))
    assert log.version() == 0 and log.latest() is None and log.entries("who string").count() == 0
    assert log.commit(0, {"who": "first"}) == 1
    with pytest.raises(CommitConflict):
        other.commit(0, {"who": "second"})
    assert other.latest() == {"who": "first"} and other.commit(1, {"who": "third ü"}) == 2
    assert sorted(r.who for r in log.entries("who string").collect()) == ["first", "third ü"]
    # what a writer left behind before its rename is no commit
    (tmp_path / "log" / ".half").write_text("{")
    assert log.version() == 2


# --- tables at one instant ---


def test_star_changes_at_one_instant(spark, bank, tmp_path, monkeypatch):
    base = str(tmp_path / "star")
    assert analytical.rebuild_star(bank, base) == 1
    star = analytical.load_star(spark, base)
    facts = star.fact_transaction.count()
    fewer = analytical.build_star(bank).tables()
    fewer["fact_transaction"] = fewer["fact_transaction"].limit(3)
    broken = {**fewer, "dim_branch": fewer["dim_branch"].withColumn("city", F.raise_error(F.lit("stop")).cast("string"))}
    # a build that fails between two tables leaves all old ones
    with pytest.raises(Exception, match="stop"):
        publish_together(broken, base)
    assert {n: t.count() for n, t in read_together(spark, base).items()} == {n: t.count() for n, t in star.tables().items()}
    # two builds from the same state: the second to commit changes nothing
    publish_together(fewer, base, seen=1)
    with pytest.raises(CommitConflict):
        publish_together(analytical.build_star(bank).tables(), base, seen=1)
    assert read_together(spark, base)["fact_transaction"].count() == 3
    # a reader that holds the old star still reads it whole
    assert star.fact_transaction.count() == facts == read_together(spark, base, 1)["fact_transaction"].count()
    with pytest.raises(FileNotFoundError):
        read_together(spark, str(tmp_path / "nothing"))


# --- two runs at a time ---


def reference(spark):
    return spark.createDataFrame(ACCOUNTS, ACCOUNT)


def landing(folder, seed):
    folder.mkdir()
    for name, lines in branch_files(seed).items():
        write_lines(folder, name, lines)
    return str(folder)


def test_the_overtaken_run_fails_whole_and_starts_again(spark, tmp_path, monkeypatch):
    folder, base = landing(tmp_path / "in", 5), str(tmp_path / "store")
    accounts, plain = reference(spark), medallion.ingest
    raced = []

    def ingest(store, run_id, recognized):
        done = plain(store, run_id, recognized)
        if not raced:
            raced.append(run_id)
            other = run_medallion(spark, folder, base, accounts)
            assert other["status"] == "SUCCESS"
        return done

    monkeypatch.setattr(medallion, "ingest", ingest)
    result = run_medallion(spark, folder, base, accounts)
    assert result["status"] == "FAILED" and result["reason"].startswith("validate failed: CommitConflict")
    store = Store(spark, base)
    silver = store.silver()
    # only the winner's rows, ids and files count
    assert silver.filter(F.col("run_id") == raced[0]).count() == 0 < silver.count()
    assert silver.count() == silver.select("transaction_id").distinct().count()
    assert {r.run_id for r in store.file_events().filter("file_status = 'PROCESSED'").collect()} == {r.run_id for r in silver.select("run_id").distinct().collect()}
    gold = {tuple(r) for r in store.gold().drop("published_run_id").collect()}
    assert gold == {tuple(r) for r in medallion.gold_with_dataframe(silver).collect()}
    # with a second attempt the overtaken run ends well: the files are known by then
    raced.clear()
    more = landing(tmp_path / "more", 6)
    plain_folder, folder = folder, more
    result = run_medallion(spark, more, base, accounts, attempts=2)
    assert result["status"] == "SUCCESS" and "skipped_identical=9" in result["reason"] and plain_folder != folder


# --- id index ---


def frame(spark, values, name="id"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_index_finds_what_earlier_runs_accepted(spark, tmp_path):
    rng = random.Random(4)
    index = IdIndex(spark, str(tmp_path / "ids"), buckets=8)
    runs = {f"R{i}": [f"T{i}-{j}" for j in range(rng.choice([3, 400, 3000]))] for i in range(4)}
    for run, ids in runs.items():
        index.add(run, frame(spark, ids))
    index.add("EMPTY", frame(spark, []))
    committed = ["R0", "R1", "R3"]
    batch = [*runs["R0"][:50], *runs["R2"][:50], *runs["R3"][-50:], *[f"new-{i}" for i in range(2000)], "", None, "T0-1", "T0-1"]
    got = sorted(r.id for r in index.seen(frame(spark, batch), frame(spark, committed, "run_id")).collect())
    known = {i for r in committed for i in runs[r]}
    assert got == sorted({b for b in batch if b in known})
    assert index.seen(frame(spark, batch), frame(spark, [], "run_id")).count() == 0
    assert index.seen(frame(spark, []), frame(spark, committed, "run_id")).count() == 0


def test_index_opens_few_files(spark, tmp_path):
    index = IdIndex(spark, str(tmp_path / "ids"), buckets=64)
    for run in range(3):
        index.add(f"R{run}", frame(spark, [f"T{run}-{j}" for j in range(5000)]))
    runs = frame(spark, ["R0", "R1", "R2"], "run_id")
    everything = len(spark.read.parquet(f"{tmp_path}/ids/ids").inputFiles())
    batch = frame(spark, ["T0-7", "T2-4999", *[f"new-{i}" for i in range(300)]])
    passed, folders = index.candidates(batch, runs)
    assert 2 <= len(folders) <= 8 and everything >= 3 * 5 and passed.count() <= 8
    found = index.seen(batch, runs)
    assert sorted(r.id for r in found.collect()) == ["T0-7", "T2-4999"] and sum("/ids/ids/" in f for f in found.inputFiles()) == len(folders)
    # nothing but new ids mostly opens nothing
    assert len(index.candidates(frame(spark, [f"fresh-{i}" for i in range(100)]), runs)[1]) <= 2


# --- keyed table ---

BATCH = "transaction_id string, account_id string, transaction_date string, transaction_type string, amount string, currency string, source_file string, row_no long"


def state_schema(spark):
    return spark.createDataFrame([], "transaction_id string, account_id string, transaction_date date, transaction_type string, amount decimal(18,2), currency string, source_file string").schema


def test_upsert_rewrites_its_own_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "table"), "transaction_id", state_schema(spark), buckets=16)
    accounts = spark.createDataFrame([("A1",), ("A2",)], "account_id string")
    first = [(f"T{i}", "A1", "2031-03-01", "CREDIT", f"{i + 1}.00", "USD", "transactions_20310301.csv", i + 1) for i in range(200)]
    upsert.upsert_batch(table, spark.createDataFrame(first, BATCH), accounts)
    before = table.folders()
    second = [
        ("T7", "A2", "2031-03-02", "DEBIT", "5.00", "USD", "transactions_20310302.csv", 1),
        ("T7", "A2", "2031-03-02", "DEBIT", "6.00", "USD", "transactions_20310302.csv", 2),
        ("T9", "A1", "2031-03-02", "DEBIT", "5.00", "USD", "transactions_20310201.csv", 1),
        ("T11", "unknown", "2031-03-02", "DEBIT", "5.00", "USD", "transactions_20310302.csv", 3),
        ("N1", "A2", "2031-03-02", "DEBIT", "5.00", "USD", "transactions_20310302.csv", 4),
        ("", "A2", "2031-03-02", "DEBIT", "5.00", "USD", "transactions_20310302.csv", 5),
    ]
    stored = table.read()
    flagged, number = upsert.upsert_batch(table, spark.createDataFrame(second, BATCH), accounts)
    assert number == 2 and sorted(r.outcome for r in upsert.outcomes(flagged).collect()) == ["inserted", "rejected", "rejected", "skipped_stale", "updated", "updated"]
    after = table.folders()
    changed = {b for b in after if after[b] != before.get(b)}
    assert changed == set(table.touched(frame(spark, ["T7", "N1"], "transaction_id"))) and len(changed) <= 2 < len(after)
    rows = {r.transaction_id: r for r in table.read().collect()}
    assert len(rows) == table.read().count() == 201
    assert str(rows["T7"].amount) == "6.00" and str(rows["T9"].amount) == "10.00" and "T11" in rows and rows["N1"].account_id == "A2"
    # a reader of the old state keeps it, an empty batch commits nothing, a late writer fails
    assert stored.count() == 200
    assert table.upsert(table.read().limit(0)) == 2
    with pytest.raises(CommitConflict):
        table.upsert(table.read().limit(1), seen=1)
    assert table.log.version() == 2


def test_table_and_full_merge_agree(spark, tmp_path):
    rng = random.Random(9)
    table = KeyedTable(spark, str(tmp_path / "t"), "transaction_id", state_schema(spark), buckets=4)
    accounts = spark.createDataFrame([("A1",)], "account_id string")
    whole = table.read()
    for day in range(3):
        rows = [(f"T{rng.randrange(60)}", rng.choice(["A1", "A1", "X"]), "2031-03-01", "CREDIT", rng.choice(["1.50", "-2", "3"]), "USD", f"transactions_2031030{rng.choice([day, 1])}.csv", i) for i in range(50)]
        batch = spark.createDataFrame(rows, BATCH)
        whole = upsert.merged(whole, upsert.flag_rows(whole, batch, accounts))
        upsert.upsert_batch(table, batch, accounts)
    assert sorted(map(str, table.read().select(*whole.columns).collect())) == sorted(map(str, whole.collect()))


# --- fingerprints ---


def test_fingerprints_find_every_difference(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, "a", "b"]), rng.choice([0.0, -0.0, float("nan"), None])) for _ in range(400)]
    schema = "a int, b string, c double"
    left = spark.createDataFrame(rows, schema)
    for change in ([], [(None, "a", 1.0)], [(1, None, 1.0), (1, None, 1.0)], rows[:1]):
        shuffled = rows + change
        rng.shuffle(shuffled)
        right = spark.createDataFrame(shuffled, schema)
        assert sets.same_rows(left, right) == (not change)
        surplus = sets.multiset_difference(left, right)
        assert surplus.agg(F.sum(F.col("right_rows") - F.col("left_rows"))).first()[0] == (len(change) or None)
    # a value that moves to the next column, and rows that swap in pairs, are differences
    assert not sets.same_rows(spark.createDataFrame([(None, "x")], "a string, b string"), spark.createDataFrame([("x", None)], "a string, b string"))
    one, other = [(1,)] * 2 + [(2,)] * 4, [(1,)] * 4 + [(2,)] * 2
    assert not sets.same_rows(spark.createDataFrame(one, "a int"), spark.createDataFrame(other, "a int"))
    # equal values of different types
    assert sets.same_rows(spark.createDataFrame([(5,)], "a int"), spark.createDataFrame([(5,)], "a long"))


def test_equal_tables_shuffle_no_rows(spark):
    big = spark.range(100_000).selectExpr("id", "concat('text ', id) AS t")
    again = spark.range(99_999, -1, -1).selectExpr("id", "concat('text ', id) AS t")
    plan = sets.multiset_difference(big, again)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and sets.multiset_difference(big, again).isEmpty()
    assert len(sets._fingerprints(big, ["id", "t"], 64).collect()) == 64
