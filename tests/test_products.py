"""Customer summary, layered models and sinks."""

import json
from decimal import Decimal

import pytest
from fixtures import ACCOUNTS, CUSTOMERS, Ledger, bank, branch_files, half_up, rows, write_lines
from pyspark.sql import functions as F

from ledgerloom.operators import rules as R
from ledgerloom.plans import customer_summary as C
from ledgerloom.plans import layered
from ledgerloom.plans.medallion import Store, run_medallion
from ledgerloom.schemas import SEED_ACCOUNT, SEED_CUSTOMER, SEED_TRANSACTION
from ledgerloom.sinks.lookup_table import look_up, write_for_lookup
from ledgerloom.sinks.publish import current_csv, current_version, publish, read_current, write_checked_parquet


FILES = branch_files(8, days=4)
# references: a customer without a name, a repeat, an account of nobody, one of an unknown customer
PEOPLE = [(c[0], c[1], c[3]) for c in CUSTOMERS] + [("K08", "", "HOME"), ("K01", "Holder again", "CORP")]
OWNED = [*ACCOUNTS, ("P13", "K99", "N10", "CURRENT", "OPEN"), ("P14", "K02", "", "CURRENT", "OPEN")]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("summary")
    landing = base / "landing"
    landing.mkdir()
    for name, lines in FILES.items():
        write_lines(landing, name, lines)
    store = Store(spark, str(base / "store"))
    assert run_medallion(spark, str(landing), store.base, bank(spark).account)["status"] == "SUCCESS"
    write_lines(base, "customers.csv", PEOPLE, header=",".join(C.CUSTOMER_COLUMNS))
    write_lines(base, "accounts.csv", OWNED, header=",".join(C.ACCOUNT_COLUMNS))
    result = C.build_customer_summary(
        spark, str(base / "customers.csv"), str(base / "accounts.csv"), store.silver(), store.exceptions())
    return result, base


@pytest.fixture(scope="module")
def ledger():
    done = Ledger(a[0] for a in ACCOUNTS)
    done.deliver(FILES)
    return done


def gold_rows(ledger):
    """Per customer: accounts, transactions, total and latest day."""
    out = []
    for cid, name, *_ in CUSTOMERS:
        own = {a[0] for a in ACCOUNTS if a[1] == cid}
        mine = [r for r in ledger.accepted.values() if r[1] in own]
        total = sum((half_up(r[4]) for r in mine), Decimal(0))
        out.append((cid, name, len(own), len(mine), float(total), max((r[2] for r in mine), default=None)))
    return out


def test_gold(built, ledger):
    assert rows(built[0].gold.orderBy("customer_id")) == gold_rows(ledger)


def test_exceptions(built, ledger):
    found = {(r.source_filename, r.source_row_number): r for r in built[0].exceptions.collect()}
    imported = {(name, place): reasons for name, place, _, reasons in ledger.rejected}
    assert set(found) == set(imported) | {("customers.csv", 9), ("customers.csv", 10), ("accounts.csv", 14), ("accounts.csv", 15)}
    for place, reasons in imported.items():
        assert reasons in found[place].rejection_reasons and found[place].entity_type == "TRANSACTION"
    orphan = found["accounts.csv", 14]
    assert (orphan.entity_type, orphan.customer_id, orphan.account_id, orphan.transaction_id) == ("ACCOUNT", "K99", "P13", None)
    assert orphan.rejection_reasons == R.CUSTOMER_UNKNOWN
    assert json.loads(orphan.raw_record) == dict(zip(C.ACCOUNT_COLUMNS, OWNED[12]))
    assert found["customers.csv", 9].rejection_reasons == R.CUSTOMER_NAME_MISSING
    assert found["customers.csv", 10].rejection_reasons == R.CUSTOMER_REPEATED
    owner = {a[0]: a[1] for a in ACCOUNTS}
    for (name, place), r in found.items():
        if name in FILES:
            account = FILES[name][place - 1][1]
            assert r.customer_id == owner.get(account)
    assert len({r.exception_id for r in found.values()}) == len(found)


def test_summary_figures(built, ledger):
    got = {r.metric: r.value for r in built[0].summary.collect()}
    total = sum((half_up(r[4]) for r in ledger.accepted.values()), Decimal(0))
    expected = {
        "customers_loaded": 7, "accounts_loaded": 12, "exceptions_total": len(ledger.rejected) + 4,
        "exceptions_by_entity: ACCOUNT": 2, "exceptions_by_entity: CUSTOMER": 2,
        "exceptions_by_entity: TRANSACTION": len(ledger.rejected),
        "mapped_silver_transactions": len(ledger.accepted), "unmapped_silver_transactions": 0, "gold_total_amount": total,
    }
    assert {k: got[k] for k in expected} == {k: str(v) for k, v in expected.items()}


def test_lookup(spark, built, ledger):
    gold, shown = built[0].gold, {r[0]: [(r[0], *r[2:5])] for r in gold_rows(ledger)}
    assert rows(C.customer_lookup(gold, " K01 ")) == shown["K01"]
    assert rows(C.customer_lookup(gold, "K%30%35")) == shown["K05"]
    for unknown in ("K99", "K01' OR 'a'='a", "K01%22%20OR%201"):
        assert rows(C.customer_lookup(gold, unknown)) == []
    for empty in ("", " ", "%20%20"):
        with pytest.raises(ValueError, match="Customer ID is required"):
            C.customer_lookup(gold, empty)
    ids = spark.createDataFrame([(" K02 ",), ("K77",), ("K02",)], "customer_id string")
    assert rows(C.customer_lookups(gold, ids)) == shown["K02"]


def test_stored_lookup_opens_one_file(spark, built, ledger, tmp_path):
    gold, shown = built[0].gold, {r[0]: [(r[0], *r[2:5])] for r in gold_rows(ledger)}
    C.store_for_lookup(gold, str(tmp_path / "gold"), rows_per_file=2)
    assert rows(C.stored_customer(spark, str(tmp_path / "gold"), " K0%32 ")) == shown["K02"]
    assert rows(C.stored_customer(spark, str(tmp_path / "gold"), "K99")) == []

    numbers = spark.range(1000).select(F.when(F.col("id") % 100 > 0, F.col("id")).alias("id"), F.lit("x").alias("file"))
    write_for_lookup(numbers, str(tmp_path / "numbers"), "id", rows_per_file=100)
    assert spark.read.parquet(str(tmp_path / "numbers" / "rows")).count() == 1000
    for wanted in (1, 250, 499, 999):
        found = look_up(spark, str(tmp_path / "numbers"), "id", wanted)
        assert rows(found) == [(wanted, "x")]
        assert len(found.inputFiles()) == 1
    assert [rows(look_up(spark, str(tmp_path / "numbers"), "id", v)) for v in (300, 5000, None)] == [[], [], []]
    write_for_lookup(numbers.limit(0), str(tmp_path / "none"), "id")
    assert rows(look_up(spark, str(tmp_path / "none"), "id", 1)) == []


def test_publish_summary(built, spark, ledger):
    result, base = built
    home = str(base / "out")
    assert C.publish_customer_summary(result, home, "v1") == (7, len(ledger.rejected) + 4)
    assert read_current(spark, f"{home}/customer_360").count() == 7
    with pytest.raises(FileExistsError, match="already published"):
        C.publish_customer_summary(result, home, "v1")


def test_reference_repeats_and_faults(spark):
    def ref(data, columns):
        return spark.createDataFrame(
            [("f.csv", i, *r, []) for i, r in enumerate(data, 2)],
            "source_filename string, source_row_number long, " + ", ".join(f"{c} string" for c in columns) + ", row_issues array<string>")

    customers = C.check_customers(ref([("C1", "", "R"), ("C1", "A", "R"), ("C1", "B", ""), ("", "", "")], C.CUSTOMER_COLUMNS))
    got = [r.reasons for r in customers.orderBy("source_row_number").collect()]
    again = "duplicate customer_id; first valid record wins"
    assert got == [["customer_name is missing"], [], ["customer_segment is missing", again],
                   ["customer_id is missing", "customer_name is missing", "customer_segment is missing"]]
    accounts = C.check_accounts(
        ref([("A1", "C9", "B", "T", "S"), ("A1", "C1", "B", "T", "S"), ("A1", "C9", "B", "T", "")], C.ACCOUNT_COLUMNS),
        C.accepted(customers, C.CUSTOMER_COLUMNS))
    got = [r.reasons for r in accounts.orderBy("source_row_number").collect()]
    unknown = "customer_id not found in customers reference"
    assert got == [[unknown], [], ["account_status is missing", "duplicate account_id; first valid record wins", unknown]]


def test_gold_that_does_not_reconcile(built):
    result, _ = built
    silver = result.gold.limit(0).select(F.lit("P01").alias("account_id"), F.lit(1).cast("decimal(18,2)").alias("amount"))
    figures = C.reconcile(result.gold, silver, result.accounts).first()
    with pytest.raises(ValueError, match="Customer 360 reconciliation failed"):
        C.assert_gold_reconciled(figures)


# --- layered models ---


def seeds(spark):
    """Padded and mixed-case seeds; transaction i has kind i mod 3 and i.25 of money."""
    customers = spark.createDataFrame([(f"S{i}", f" Seed {i} ", "Narvik ", " corp") for i in range(5)], SEED_CUSTOMER)
    accounts = spark.createDataFrame([(f"D{i}", f"S{i % 5}", "Current ", "2030-05-05", " open") for i in range(9)], SEED_ACCOUNT)
    kinds = ("purchase", " WITHDRAWAL", "Deposit ")
    transactions = spark.createDataFrame(
        [(f"M{i}", f"D{i % 9}", f"2031-04-{1 + i % 20:02d}", f"{i + 1}.25", kinds[i % 3], " usd") for i in range(40)], SEED_TRANSACTION)
    return customers, accounts, transactions


def test_layers(spark):
    raw = seeds(spark)
    layers = layered.build_layers(*raw)
    assert {n: df.count() for n, df in layers.items()} == {
        "stg_customers": 5, "stg_accounts": 9, "stg_transactions": 40, "int_transaction_enriched": 40,
        "dim_accounts": 9, "fct_daily_account_activity": len({(i % 9, i % 20) for i in range(40)})}
    results = layered.layer_test_results(layers, raw[2]).collect()
    assert len(results) == 12 and all(r.passed for r in results)
    clean = layers["stg_accounts"].first()
    assert (clean.account_type, clean.account_status) == ("Current", "OPEN")
    figures = layers["fct_daily_account_activity"].agg(F.sum("total_deposits"), F.sum("total_outflows"), F.sum("net_amount")).first()
    inflow = sum(i + 1.25 for i in range(40) if i % 3 == 2)
    outflow = sum(i + 1.25 for i in range(40) if i % 3 < 2)
    assert tuple(map(float, figures)) == (inflow, outflow, inflow - outflow)


def test_layer_tests_find_faults(spark):
    c, a, t = seeds(spark)
    extra = spark.createDataFrame(
        [("M1", "D99", "2031-04-01", "-5.00", "FEE", "USD"), (None, None, "2031-04-01", "x", "DEPOSIT", "USD")], SEED_TRANSACTION)
    raw = t.unionByName(extra)
    bad_layers = layered.build_layers(c, a, raw.filter(F.col("amount") != "x"))
    results = {r.test_name: r.failing_rows for r in layered.layer_test_results(bad_layers, raw).collect() if not r.passed}
    assert results == {
        "unique_stg_transactions_transaction_id": 2,
        "relationships_stg_transactions_account_id": 1,
        "accepted_values_stg_transactions_transaction_type": 1,
        "assert_nonnegative_transaction_amount": 1,
    }


# --- sinks ---


def test_publish_switches_only_after_the_check(spark, tmp_path):
    base = str(tmp_path / "gold")
    one = spark.createDataFrame([("BR001", 500.0)], "branch_id string, total double")
    assert publish(one, base, "v1", ["total"]) == 1
    broken = spark.createDataFrame([("BR009", None)], "branch_id string, total double")
    with pytest.raises(ValueError, match="total is NULL"):
        publish(broken, base, "v2", ["total"])
    assert current_version(spark, base) == "v1"
    assert [tuple(r) for r in read_current(spark, base).collect()] == [("BR001", 500.0)]
    assert publish(one.limit(0), base, "v3") == 0
    assert read_current(spark, base).count() == 0
    with pytest.raises(FileExistsError, match="already published"):
        publish(one, base, "v1")
    large = spark.createDataFrame([("123456789012.10",), ("40",), ("7.05",)], "t string").select(F.col("t").cast("decimal(18,2)").alias("total"))
    publish(large, base, "v4", order=["total"])
    plain = [r.value for r in spark.read.text(current_csv(spark, base)).collect()]
    assert sorted(v for v in plain if v != "total") == ["123456789012.1", "40.0", "7.05"]
    header = [p.read_text() for p in (tmp_path / "gold" / "v3" / "csv").glob("part-*.csv")]
    assert header == ["branch_id,total\n"]


def test_checked_parquet(spark, tmp_path):
    df = spark.range(1000).repartition(5)
    for _ in range(2):
        assert write_checked_parquet(df, str(tmp_path / "t")) == (1000, 1000)
