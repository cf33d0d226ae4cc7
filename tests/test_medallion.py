"""Many runs over growing deliveries against a plain ledger: rerun, fault, repair, late repeats."""

import pytest
from fixtures import ACCOUNTS, Ledger, branch_files, half_up, rows, write_lines

from ledgerloom.plans import audit_queries
from ledgerloom.plans.medallion import Store, run_medallion, transform, validate
from ledgerloom.schemas import ACCOUNT, SILVER
from ledgerloom.sinks.publish import current_csv

GOLD = ["branch_id", "transaction_date", "transaction_type", "transaction_count", "total_amount"]
BROKEN = "BR7_20310305_TRANSACTION.csv"


def reference(spark):
    return spark.createDataFrame(ACCOUNTS, ACCOUNT)


def published_csv(store):
    """Lines of the published file, part headers left out."""
    text = store.spark.read.text(current_csv(store.spark, store.gold_home)).collect()
    return sorted(r.value for r in text if r.value != ",".join(GOLD))


def state(store):
    silver = store.silver().select("transaction_id", "account_id", "transaction_date", "transaction_type", "amount", "source_filename", "source_row_number")
    rejected = store.exceptions().select("source_filename", "source_row_number", "transaction_id", "rejection_reasons")
    return {
        "silver": sorted(rows(silver)),
        "rejected": sorted(rows(rejected)),
        "gold": sorted(rows(store.gold().select(GOLD))),
        "csv": published_csv(store),
        "bronze": store.bronze().count(),
    }


def expected(ledger):
    silver = sorted((r[0], r[1], r[2], r[3], float(half_up(r[4])), r[6], r[7]) for r in ledger.accepted.values())
    gold = ledger.gold()
    csv = sorted(",".join([b, d, k, str(n), repr(total)]) for b, d, k, n, total in gold)
    return {"silver": silver, "rejected": sorted(ledger.rejected), "gold": gold, "csv": csv}


@pytest.fixture(scope="module")
def story(spark, tmp_path_factory):
    """What the store held after each of five runs, and what the ledger held."""
    base = tmp_path_factory.mktemp("story")
    landing = base / "landing"
    landing.mkdir()
    store, ledger, seen, told = Store(spark, str(base / "store")), Ledger(a for a, *_ in ACCOUNTS), set(), []

    def run(new, counts=True):
        for name, lines in new.items():
            write_lines(landing, name, lines)
        result = run_medallion(spark, str(landing), store.base, reference(spark))
        fresh = {n: r for n, r in new.items() if n not in seen}
        done = ledger.deliver(fresh) if counts else (0, 0)
        seen.update(fresh if counts else ())
        told.append({"result": result, "done": done, "new": len(fresh), "store": state(store), "ledger": expected(ledger)})

    first, second = branch_files(1), branch_files(2, days=2, branches=("BR44", "BR33"))
    (landing / "readme.md").write_text("no delivery")
    run(first)
    run({})
    write_lines(landing, BROKEN, ["only,two"], header="some,header")
    run({}, counts=False)
    late = list(first.values())[0][:4]
    (landing / BROKEN).unlink()
    run({**second, "BR1_20310309_TRANSACTION.csv": late})
    run({})
    return store, told


@pytest.mark.parametrize("step", range(5))
def test_store_equals_the_ledger(story, step):
    told = story[1][step]
    assert {k: told["store"][k] for k in told["ledger"]} == told["ledger"]


def test_results(story):
    _, told = story
    assert [t["result"]["status"] for t in told] == ["SUCCESS", "SUCCESS", "FAILED", "SUCCESS", "SUCCESS"]
    loaded = 0
    for t in (t for t in told if t["result"]["status"] == "SUCCESS"):
        good, bad = t["done"]
        assert t["result"]["reason"] == (
            f"files loaded={t['new']}, skipped_identical={loaded}, unrecognized=1; accepted={good}, rejected={bad}; "
            f"gold_rows={len(t['ledger']['gold'])}")
        loaded += t["new"]
    assert told[2]["result"]["reason"].startswith(f"ingest failed: ValueError: {BROKEN}: header does not match")
    assert told[2]["store"]["bronze"] == told[1]["store"]["bronze"]
    assert any("already accepted" in r[3] for r in told[3]["ledger"]["rejected"] if r[0] == "BR1_20310309_TRANSACTION.csv")


def test_audit(story):
    store, told = story
    audit = {r.run_id: r for r in store.run_audit().collect()}
    for t in told:
        entry = audit[t["result"]["run_id"]]
        assert (entry.status, entry.status_reason) == (t["result"]["status"], t["result"]["reason"]) and entry.finished_at is not None
    skipped = store.file_audit().filter("file_status = 'SKIPPED_IDENTICAL'").collect()
    assert skipped and all(r.note.startswith("identical content already processed as ") for r in skipped)
    totals = audit_queries.gold_against_silver(store.gold(), store.silver()).first()
    assert totals.gold_total == totals.silver_total
    assert audit_queries.latest_runs(store.run_audit()).count() == 5
    newest = [r.run_id for r in audit_queries.latest_runs(store.run_audit(), 2).collect()]
    assert newest == [t["result"]["run_id"] for t in told[:-3:-1]]
    assert audit_queries.file_reconciliation(store.file_audit(), 4).count() == 4
    assert audit_queries.latest_exceptions(store.exceptions(), 3).count() == 3
    delivered = {r[0]: (r[2], r[5].split("_")[1]) for r in told[-1]["ledger"]["silver"]}
    apart = sorted(t for t, (day, file) in delivered.items() if day.replace("-", "") != file)
    assert sorted(r.transaction_id for r in audit_queries.date_disagreements(store.silver(), store.file_audit()).collect()) == apart


def test_missing_landing_folder(spark, tmp_path):
    result = run_medallion(spark, str(tmp_path / "gone"), str(tmp_path / "store"), reference(spark))
    assert result["status"] == "FAILED" and result["reason"].startswith("discover failed: FileNotFoundError")
    assert [r.status for r in Store(spark, str(tmp_path / "store")).run_audit().collect()] == ["FAILED"]


def test_gold_computed_two_ways_must_agree(spark, story):
    other = "branch_id string, transaction_date date, transaction_type string, transaction_count long, total_amount decimal(28,2)"
    with pytest.raises(ValueError, match="PySpark and SQL Gold results differ"):
        transform(story[0].silver(), second=lambda s: s.sparkSession.createDataFrame([("BR1", None, "CREDIT", 5, None)], other))
    assert transform(spark.createDataFrame([], SILVER)).count() == 0


def test_nothing_loaded_gives_no_results(spark, tmp_path):
    assert validate(Store(spark, str(tmp_path)), "RUN_NONE", reference(spark)).count() == 0


@pytest.mark.parametrize("fault, text", [
    ("P01,2031-03-01,CREDIT,4.00,USD", "data row 1 has 5 fields, expected 6"),
    ('Z2,P01,2031-03-01,CREDIT,4.00,"US', "field larger than field limit (131072)"),
    (None, "file is empty"),
])
def test_a_bad_file_stops_the_step_and_leaves_earlier_ones_loaded(spark, tmp_path, fault, text):
    landing = tmp_path / "landing"
    landing.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    sound, bad = "BR1_20310301_TRANSACTION.csv", "BR2_20310301_TRANSACTION.csv"
    write_lines(landing, sound, [("Z1", "P01", "2031-03-01", "CREDIT", "7.00", "USD"), "", ("Z3", "P01", "2031-03-01", "DEBIT", "", "USD")])
    if fault is None:
        (landing / bad).write_text("")
    else:
        write_lines(landing, bad, [fault, *["x" * 1000] * (140 if "US" == fault[-2:] else 0)])
    result = run_medallion(spark, str(landing), store.base, reference(spark))
    assert result["reason"] == f"ingest failed: ValueError: {bad}: {text}"
    kept = store.bronze().select("source_filename", "source_row_number", "transaction_id", "amount").collect()
    assert sorted(map(tuple, kept)) == [(sound, 1, "Z1", "7.00"), (sound, 2, "Z3", "")]
    assert [(r.source_filename, r.file_status) for r in store.file_audit().collect()] == [(sound, "LOADED")]
    assert store.silver().count() == 0


def test_bronze_ids_follow_from_places(spark, tmp_path):
    """Rows on their way from bronze to silver and exceptions carry no id, and get the id that bronze has."""
    from pathlib import Path

    from ledgerloom.session import shared_folder

    landing, store = tmp_path / "landing", Store(spark, str(tmp_path / "store"))
    landing.mkdir()
    write_lines(landing, "BR5_20310301_TRANSACTION.csv", ["Z1,P01,2031-03-01,CREDIT,5.00,USD", "Z1,P01,2031-03-01,CREDIT,5.00,USD", "Z2,P02,never,CREDIT,5.00,USD"])
    known = set(Path(shared_folder(spark)).glob("checked-*"))
    assert run_medallion(spark, str(landing), store.base, reference(spark))["status"] == "SUCCESS"
    (checked,) = set(Path(shared_folder(spark)).glob("checked-*")) - known
    assert not {"bronze_id", "run_id", "load_timestamp"} & set(spark.read.parquet(str(checked)).columns)
    ids = {(r.source_row_number, r.run_id): r.bronze_id for r in store.bronze().collect()}
    rows_of = [*store.silver().collect(), *store.exceptions().collect()]
    assert len(rows_of) == len(ids) == len(set(ids.values())) == 3
    assert all(ids[r.source_row_number, r.run_id] == r.bronze_id for r in rows_of)
