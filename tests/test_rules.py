"""Row rules, repeat policies and constraints."""

import random
from collections import Counter

import pytest
from fixtures import ACCOUNTS, FAULTY, KINDS, Ledger, rows, spoiled, value_faults
from pyspark.sql import functions as F

from ledgerloom.functions.text import masked_reasons
from ledgerloom.operators import quality as Q
from ledgerloom.operators import rules as R
from ledgerloom.operators.joins import dimension_orphans, relationship_links, unmatched_rows
from ledgerloom.operators.rules import value_rules, with_verdict
from ledgerloom.plans.delivery import validate_all
from ledgerloom.plans.medallion import judge
from ledgerloom.schemas import TRANSACTION_COLUMNS
from ledgerloom.streaming.dedup import all_copies_invalid, first_accepted_wins

def subsets():
    """No fault, every single fault, and thirty mixtures."""
    rng = random.Random(4)
    some = [rng.sample(range(6), rng.randrange(2, 6)) for _ in range(30)]
    return [[], *[[c] for c in range(6) for _ in FAULTY[c]], *some]


def placed(spark, rows):
    """Rows with a delivery place: (file_date, branch, file, row number, six values)."""
    return spark.createDataFrame(
        rows,
        "file_date string, branch_id string, source_filename string, source_row_number long, "
        + ", ".join(f"{c} string" for c in TRANSACTION_COLUMNS),
    )


def test_rules_against_the_ledger(spark):
    """Rows with every fault alone and mixed; ids of an earlier run are repeats."""
    rng, made = random.Random(7), []
    for i, columns in enumerate(subsets()):
        sound = (f"Q{i}", ACCOUNTS[i % 12][0], "2031-03-02", KINDS[i % 2], f"{i + 1}.50", "USD")
        made.append(spoiled(rng, sound, columns))
    made += [("old", "P01", "2031-03-02", "CREDIT", "1", "USD"), ("old", "P99", "2031-03-02", "CREDIT", "1", "USD")]
    ledger = Ledger(a for a, *_ in ACCOUNTS)
    ledger.accepted["old"] = None
    expected = {i: ledger.judge(row) for i, row in enumerate(made)}
    assert len({tuple(r) for r in expected.values()}) > 20
    accounts = spark.createDataFrame([(f"{a[0]} ",) for a in ACCOUNTS], "account_id string")
    earlier = spark.createDataFrame([("old",)], "transaction_id string")
    df = placed(spark, [("2031-03-02", "BR1", "F", i, *row) for i, row in enumerate(made)])
    assert {r.source_row_number: r.reasons for r in judge(df, accounts, earlier).collect()} == expected


def test_first_accepted_wins_by_place(spark):
    """Delivery order is file date, branch, file, row, whatever the order of the rows at hand."""
    rng, made = random.Random(12), []
    for day in ("2031-03-02", "2031-03-03"):
        for branch in ("BR2", "BR10"):
            for file in ("Fa", "Fb"):
                for n in range(1, 11):
                    account = rng.choice(["P01", "P01", "P99"])
                    made.append((day, branch, f"{file}{day}{branch}", n, rng.choice(["A", "B", "C", "", "D"]), account, day, "CREDIT", "1.00", "USD"))
    ledger = Ledger(["P01"])
    expected = {r[2:4]: ledger.judge(r[4:]) for r in sorted(made, key=lambda r: r[:4])}
    accounts = spark.createDataFrame([("P01",)], "account_id string")
    for parts in (1, 5):
        rng.shuffle(made)
        got = judge(placed(spark, made).repartition(parts), accounts).collect()
        assert {(r.source_filename, r.source_row_number): r.reasons for r in got} == expected


@pytest.mark.parametrize("numbers", [[1, 2, 3, 4], [-5, 0, 3, 2**40], [1, 2, 2**62, 2**62 + 1]])
def test_only_asked_columns_move(spark, numbers):
    """What a caller does not ask for is judged where it is read; verdicts hold for row numbers of any size."""
    ids = ["A", " ", "A", None]
    made = [(day, "BR1", f"F{day}", n, i, "P01", day, "CREDIT", "1.00", "USD") for day in ("2031-03-03", "2031-03-02") for n, i in zip(numbers, ids)]
    ledger = Ledger(["P01"])
    expected = {r[2:5]: ledger.judge(("" if r[4] is None else r[4], *r[5:])) for r in sorted(made, key=lambda r: r[:4])}
    accounts = spark.createDataFrame([("P01",)], "account_id string")
    keep = ["source_filename", "source_row_number", "transaction_id"]
    judged = judge(placed(spark, made), accounts, keep=keep)
    assert judged.columns == [*keep, "reasons", "is_valid"]
    assert {(r.source_filename, r.source_row_number, r.transaction_id): r.reasons for r in judged.collect()} == expected
    written = {c for path in judged.inputFiles() if "/judged-" in path for c in spark.read.parquet(path).columns}
    assert "mask" in written and not written & {"file_date", "branch_id", "source_filename", "account_id", "amount", "currency"}


def test_row_without_a_number_keeps_its_file(spark):
    made = [("2031-03-02", "BR1", "F", n, i, "P01", "2031-03-02", "CREDIT", "1.00", "USD") for n, i in [(None, "A"), (1, "A"), (2, "A"), (None, "B")]]
    accounts = spark.createDataFrame([("P01",)], "account_id string")
    got = [(r.source_filename, r.source_row_number, r.transaction_id, r.is_valid) for r in judge(placed(spark, made), accounts).collect()]
    assert sorted(got, key=str) == [("F", 1, "A", True), ("F", 2, "A", False), ("F", None, "A", True), ("F", None, "B", True)]


def test_hot_key_against_brute_force(spark):
    """A third of all rows share one id; verdicts must equal a plain loop."""
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.34 else f"k{rng.randrange(200)}", rng.random() < 0.5) for i in range(3000)]
    df = spark.createDataFrame(rows, "place long, key string, fine boolean").repartition(7)
    accepted, expected = set(), {}
    for place, key, fine in rows:
        expected[place] = key in accepted
        if fine and key not in accepted:
            accepted.add(key)
    got = {r.place: r.repeat for r in first_accepted_wins(df, "key", F.col("fine"), ["place"], "repeat").collect()}
    assert got == expected


def test_all_copies_are_invalid(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    got = sorted((str(r.k), r.again) for r in all_copies_invalid(df, "k", "again").collect())
    assert got == [("None", False), ("None", False), ("a", True), ("a", True), ("b", False)]


def test_validate_all_keeps_every_reason(spark):
    rng = random.Random(3)
    made = [spoiled(rng, (f"V{i // 2 if i % 5 == 0 else i}", "P01", "2031-03-02", "DEBIT", "3", "USD"), c) for i, c in enumerate(subsets())]
    ids = Counter(r[0] for r in made)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(made)], "i int, " + ", ".join(f"{c} string" for c in TRANSACTION_COLUMNS))
    for r in validate_all(df).collect():
        row = made[r.i]
        reasons = value_faults(row) + [R.REPEATED_ID] * (ids[row[0]] > 1)
        assert (r.error_reason, r.is_valid) == ("; ".join(reasons), not reasons)


def test_masked_reasons_of_every_mask(spark):
    """Nine rules, so the last one has a look-up of its own."""
    texts = [f"r{i}" for i in range(9)]
    got = spark.range(1 << 9).select("id", masked_reasons(F.col("id").cast("int"), texts).alias("reasons")).collect()
    assert {r.id: r.reasons for r in got} == {n: [x for i, x in enumerate(texts) if n >> i & 1] for n in range(1 << 9)}


def test_rules_need_no_python_worker(spark):
    df = spark.createDataFrame([], ", ".join(f"{c} string" for c in TRANSACTION_COLUMNS))
    plan = with_verdict(df, value_rules())._jdf.queryExecution().toString()
    assert "Python" not in plan


# --- checks, gate, tests, constraints ---


def test_checks_pass_on_sound_tables(spark, bank):
    checks = Q.with_status(Q.run_checks(bank.tx, bank.account, bank.customer, bank.branch))
    got = {r.check: (r.bad, r.status) for r in checks.collect()}
    assert set(got) == set(Q.CHECK_ORDER)
    assert set(got.values()) == {(0, "PASS")}
    Q.gate(checks)


def test_checks_find_faults_and_the_gate_names_them(spark, bank):
    extra = spark.createDataFrame(
        [("Z1", "P99", -5.0), ("Z1", "P01", 0.0), (None, None, None)],
        "transaction_id string, account_id string, amount double",
    ).withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    tx = bank.tx.select("transaction_id", "account_id", "amount").unionByName(extra)
    checks = Q.run_checks(tx, bank.account, bank.customer.filter("customer_id <> 'K03'"), bank.branch)
    bad = {r.check: r.bad for r in checks.collect()}
    assert bad[Q.NULL_IDS] == bad[Q.NULL_ACCOUNTS] == bad[Q.NULL_AMOUNTS] == 1
    assert bad[Q.DUPLICATE_IDS] == 1 and bad[Q.ORPHAN_TRANSACTIONS] == 1 and bad[Q.BAD_AMOUNTS] == 2
    assert bad[Q.ORPHAN_CUSTOMERS] >= 1 and bad[Q.ORPHAN_BRANCHES] == 0
    with pytest.raises(Q.DataQualityError, match=r"7 data quality check\(s\) failed - Null transaction IDs: 1; "):
        Q.gate(checks)


def test_relationships(spark, bank):
    links = {r.relationship: r.links for r in relationship_links(bank.tx, bank.account, bank.customer, bank.branch).collect()}
    assert links == {"customer_account_links": 12, "branch_account_links": 12, "account_transaction_links": 60}
    child = spark.createDataFrame([("Z1", "P01"), ("Z2", "P99"), ("Z3", None)], "t string, account_id string")
    assert unmatched_rows(child, bank.account, "account_id").first().bad == 1
    orphans = dimension_orphans(bank.tx, {"account_id": bank.account})
    assert [tuple(r) for r in orphans.collect()] == [("account_id", 0)]


def test_declarative_tests(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("z",)], "k string")
    parent = spark.createDataFrame([("a",)], "p string")

    def found(failing):
        return sorted((r.failing_value, r.failing_rows) for r in failing.collect())

    assert found(Q.not_unique(df, "k")) == [("a", 2)]
    assert found(Q.nulls(df, "k")) == [(None, 1)]
    assert found(Q.without_parent(df, "k", parent, "p")) == [("z", 1)]
    assert found(Q.not_accepted(df, "k", ["a"])) == [("z", 1)]


def test_tests_of_one_table_share_a_scan(spark, tmp_path):
    data = [("a", 1), ("a", -2), (None, 3), ("z", None), ("z", -2), ("y", 0)]
    spark.createDataFrame(data, "k string, n int").write.parquet(str(tmp_path / "t"))
    df, parent = spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame([("a",), ("a",), (None,)], "p string")
    tests = {
        "once": Q.unique("k"), "set": Q.not_null("k"), "known": Q.has_parent("k", parent, "p"),
        "listed": Q.accepted("k", ["a", "y"]), "sign": Q.never("n", F.col("n") < 0), "fine": Q.never("n", F.col("n") > 9),
    }
    assert sorted(map(repr, rows(Q.failing_values(df, tests)))) == sorted(map(repr, [
        ("once", "a", 2), ("once", "z", 2), ("set", None, 1), ("known", "z", 2), ("known", "y", 1), ("listed", "z", 2), ("sign", "-2", 2),
    ]))
    result = Q.run_tests([(df, tests)])
    assert sorted(rows(result)) == sorted([
        ("once", 2, 4, False), ("set", 1, 1, False), ("known", 2, 3, False), ("listed", 1, 2, False), ("sign", 1, 2, False), ("fine", 0, 0, True),
    ])
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    nothing = Q.run_tests([(df.limit(0), tests)])
    assert {(r.failing_values, r.failing_rows, r.passed) for r in nothing.collect()} == {(0, 0, True)}


def test_constraints(spark, bank):
    sound = ("Z1", "P01", "2031-03-02", "CREDIT", "1.00", "USD")
    change = lambda **new: tuple(new.get(c, v) for c, v in zip(TRANSACTION_COLUMNS, sound))
    rows = [
        sound,
        change(transaction_id="Z2", account_id="P99"),
        change(transaction_id="Z3", transaction_type="FEE", amount="0.00", currency="NOK"),
        change(transaction_id="Z4", amount=None),
        change(transaction_id="Z5"),
        change(transaction_id="Z5", amount="2.00"),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in TRANSACTION_COLUMNS)).withColumn(
        "amount", F.col("amount").cast("decimal(18,2)"))
    checked = Q.check_constraints(df, "moves", "transaction_id", ["account_id", "amount"], {"account_id": bank.account}, True)
    fine, broken = Q.split_by_constraints(checked)
    assert [r.transaction_id for r in fine.collect()] == ["Z1"]
    got = {(r.transaction_id, str(r.amount)): r.violations for r in broken.collect()}
    assert got == {
        ("Z2", "1.00"): "moves foreign key account_id",
        ("Z3", "0.00"): "moves check transaction_type; moves check amount; moves check currency",
        ("Z4", "None"): "moves not null amount",
        ("Z5", "1.00"): "moves primary key transaction_id",
        ("Z5", "2.00"): "moves primary key transaction_id",
    }


def test_reconciliation_errors(spark):
    files = spark.createDataFrame([("F1", 2), ("F2", 1)], "source_filename string, source_rows long")
    checked = spark.createDataFrame([("F1", True), ("F2", False)], "source_filename string, is_valid boolean")
    with pytest.raises(ValueError, match="F1: reconciliation failed - source_rows=2, bronze=1, accepted=1, rejected=0"):
        Q.assert_reconciled(Q.reconcile_files(files, checked))
    with pytest.raises(ValueError, match="grain"):
        Q.assert_grain(checked.unionByName(checked), "source_filename")
