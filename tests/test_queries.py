"""Named queries against results computed in plain Python."""

from datetime import date
from decimal import Decimal

import pytest
from fixtures import ACCOUNTS, BRANCHES, CUSTOMERS, EVERYTHING, FIRST_DAY, half_up, rows, transactions
from pyspark.sql import functions as F

from ledgerloom.operators import aggregates as A
from ledgerloom.operators import ordered, sets
from ledgerloom.operators import transforms as P
from ledgerloom.operators.joins import detail
from ledgerloom.operators.quality import DataQualityError, join_completeness
from ledgerloom.plans import analytical, branch_report, operational
from ledgerloom.plans.operational import Frames
from ledgerloom.sinks.publish import current_csv, current_version
from ledgerloom.sinks.reports import REPORT_OUTPUT
from ledgerloom.sources.tables import synthetic_transactions

# --- expected results, in plain Python ---

CUSTOMER = {c[0]: c for c in CUSTOMERS}
ACCOUNT = {a[0]: a for a in ACCOUNTS}
BRANCH = {b[0]: b for b in BRANCHES}


def groups(made, key):
    """Per key: count, total, credits, debits of its transactions."""
    out = {}
    for t in made:
        n, credits, debits = out.get(key(t), (0, Decimal(0), Decimal(0)))
        amount = Decimal(t[4])
        out[key(t)] = (n + 1, credits + amount * (t[3] == "CREDIT"), debits + amount * (t[3] == "DEBIT"))
    return {k: (n, c + d, c, d) for k, (n, c, d) in out.items()}


def customer_of(t):
    return ACCOUNT[t[1]][1]


def branch_of(t):
    return ACCOUNT[t[1]][2]


def shown(found):
    return sorted(tuple(float(v) if isinstance(v, Decimal) else v for v in row) for row in found)


def operational_results(made):
    totals, kinds = groups(made, customer_of), groups(made, lambda t: t[3])
    branches, whole = groups(made, branch_of), sum(Decimal(t[4]) for t in made)
    average = half_up(sum(g[1] for g in totals.values()) / len(totals))
    amounts = {k: [Decimal(t[4]) for t in made if t[3] == k] for k in kinds}
    name = {c: CUSTOMER[c][1] for c in CUSTOMER}
    return {
        "total_amount": [(whole,)],
        "summary_by_type": [(k, n, s, half_up(s / n)) for k, (n, s, _, _) in kinds.items()],
        "summary_by_customer": [(c, name[c], CUSTOMER[c][3], n, s, half_up(s / n)) for c, (n, s, _, _) in totals.items()],
        "summary_by_branch": [(b, BRANCH[b][1], BRANCH[b][2], n, s, half_up(s / n)) for b, (n, s, _, _) in branches.items()],
        "range_by_type": [(k, n, s, half_up(s / n), min(amounts[k]), max(amounts[k])) for k, (n, s, _, _) in kinds.items()],
        "customer_ranking": [(c, name[c], g[1], 1 + sum(o[1] > g[1] for o in totals.values())) for c, g in totals.items()],
        "branch_by_type": [(b, BRANCH[b][1], k, n, s) for (b, k), (n, s, _, _) in groups(made, lambda t: (branch_of(t), t[3])).items()],
        "above_average_customers": [(c, name[c], g[1], average) for c, g in totals.items() if g[1] > average],
        "customer_share": [(c, name[c], g[1], half_up(100 * g[1] / whole)) for c, g in totals.items()],
    }


OPERATIONAL = operational_results(FIRST_DAY)


@pytest.mark.parametrize("name", OPERATIONAL)
def test_operational_results(first_day, name):
    got = rows(operational.report(name, first_day))
    assert sorted(got) == shown(OPERATIONAL[name])
    if name in ("summary_by_customer", "summary_by_branch", "customer_ranking", "customer_share"):
        total = {"summary_by_customer": 4, "summary_by_branch": 4}.get(name, 2)
        assert [r[total] for r in got] == sorted((r[total] for r in got), reverse=True)


def test_operational_detail(first_day):
    got = rows(operational.report("transactions_with_customer", first_day))
    assert got == [(t[0], t[2], t[3], float(t[4]), "USD", t[1], customer_of(t), CUSTOMER[customer_of(t)][1]) for t in FIRST_DAY]
    got = rows(operational.report("transactions_with_branch", first_day))
    assert sorted(got) == [(t[0], t[2], t[3], float(t[4]), t[1], *BRANCH[branch_of(t)]) for t in FIRST_DAY]
    got = rows(operational.report("customer_accounts", first_day))
    assert sorted(got) == sorted((a[1], CUSTOMER[a[1]][1], a[0], a[3], *BRANCH[a[2]][1:3]) for a in ACCOUNTS)
    size = {0: "Small", 1: "Medium", 2: "Large"}
    expected = [(t[0], size[(Decimal(t[4]) >= 100) + (Decimal(t[4]) > Decimal("499.99"))]) for t in FIRST_DAY]
    assert sorted((r[0], r[4]) for r in rows(operational.report("amount_bands", first_day))) == sorted(expected)
    running = [r[4] for r in rows(operational.report("running_total", first_day))]
    assert running == [float(sum(Decimal(t[4]) for t in FIRST_DAY[: i + 1])) for i in range(len(FIRST_DAY))]


def test_account_activity_keeps_accounts_without_transactions(first_day):
    sums = groups(FIRST_DAY, lambda t: t[1])
    expected = [(a[0], a[3], a[4], sums[a[0]][0], sums[a[0]][1], half_up(sums[a[0]][1] / sums[a[0]][0])) if a[0] in sums else (a[0], a[3], a[4], 0, None, None) for a in ACCOUNTS]
    got = rows(operational.report("account_activity", first_day))
    assert {r[0]: r for r in got} == {r[0]: tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in expected}
    assert got[-1][4] is None and any(r[0] == "P12" for r in got)


def analytical_results(made):
    customers, accounts = groups(made, customer_of), groups(made, lambda t: t[1])
    return {
        "by_branch": [(b, BRANCH[b][1], n, s, c - d) for b, (n, s, c, d) in groups(made, branch_of).items()],
        "by_type": [(k, n, s) for k, (n, s, _, _) in groups(made, lambda t: t[3]).items()],
        "by_customer": [(k, CUSTOMER[k][1], CUSTOMER[k][3], n, c, d, c - d) for k, (n, _, c, d) in customers.items()],
        "by_account": [(a, ACCOUNT[a][3], n, s) for a, (n, s, _, _) in accounts.items()],
        "by_date": [(d, date.fromisoformat(d).strftime("%A"), n, s, c - e) for d, (n, s, c, e) in groups(made, lambda t: t[2]).items()],
        "by_segment_and_branch": [
            (seg, BRANCH[b][1], n, s) for (seg, b), (n, s, _, _) in groups(made, lambda t: (CUSTOMER[customer_of(t)][3], branch_of(t))).items()],
        "net_outflow_accounts": [(a, ACCOUNT[a][3], c, d, c - d) for a, (_, _, c, d) in accounts.items() if d > c],
    }


ANALYTICAL = analytical_results(EVERYTHING)


@pytest.mark.parametrize("name", ANALYTICAL)
def test_analytical_results(bank, name):
    assert sorted(rows(analytical.report(name, analytical.build_star(bank)))) == shown(ANALYTICAL[name])


def test_star_tables_and_rebuild(spark, bank, tmp_path):
    for _ in range(2):
        analytical.rebuild_star(bank, str(tmp_path / "star"))
    counts = {r.table_name: r.row_count for r in A.row_counts(
        analytical.load_star(spark, str(tmp_path / "star")).tables()).collect()}
    assert counts == {"dim_customer": 7, "dim_account": 12, "dim_branch": 4, "dim_date": 4, "fact_transaction": 60}
    star = analytical.load_star(spark, str(tmp_path / "star"))
    for name, expected in ANALYTICAL.items():
        assert sorted(rows(analytical.report(name, star))) == shown(expected)
    some = EVERYTHING[40]
    fact = star.fact_transaction.filter(F.col("transaction_id") == some[0]).first()
    assert (fact.customer_id, fact.branch_id, fact.date_key) == (customer_of(some), branch_of(some), int(some[2].replace("-", "")))
    grain = A.grain(star.fact_transaction, "transaction_id").first()
    assert grain["rows"] == grain.distinct_keys == 60


# --- row-wise operators and folds on the corrected tables ---


def test_row_operators(bank):
    tx, (_, gross, credits, debits) = bank.tx, groups(EVERYTHING, lambda t: 0)[0]
    assert P.credits_only(tx).count() == sum(t[3] == "CREDIT" for t in EVERYTHING)
    assert P.high_value(tx).count() == sum(Decimal(t[4]) >= 500 for t in EVERYTHING)
    assert P.reporting_columns(tx).columns == P.REPORTING_COLUMNS
    assert tuple(P.with_signed_amount(tx).agg(F.sum("amount"), F.sum("signed_amount")).first()) == (gross, credits - debits)
    text = tx.withColumn("transaction_date", F.col("transaction_date").cast("string"))
    assert dict(P.typed_dates(text).dtypes)["transaction_date"] == "date"


def test_folds(bank):
    by_kind = groups(EVERYTHING, lambda t: t[3])
    assert sorted(rows(A.by_type(bank.tx))) == shown((k, n, s, half_up(s / n)) for k, (n, s, _, _) in by_kind.items())
    by_branch = groups(EVERYTHING, branch_of)
    assert sorted(rows(A.by_branch(bank.tx, bank.account))) == shown((b, n, s, c - d) for b, (n, s, c, d) in by_branch.items())
    everything = dict(tx=bank.tx, accounts=bank.account, customers=bank.customer, branches=bank.branch)
    by_type = groups(EVERYTHING, lambda t: ACCOUNT[t[1]][3])
    assert sorted(rows(A.activity_by(group_by=["account_type"], **everything))) == shown((k, n, s, c - d) for k, (n, s, c, d) in by_type.items())
    named = rows(A.activity_by(group_by=["branch_id", "branch_name", "city"], **everything))
    assert sorted(named) == shown((b, *BRANCH[b][1:3], n, s, c - d) for b, (n, s, c, d) in by_branch.items())
    joined = detail(bank.tx, bank.account, bank.customer, bank.branch)
    assert joined.count() == 60 and len(joined.columns) == 16
    assert tuple(join_completeness(bank.tx, A.by_branch(bank.tx, bank.account)).first()) == (60, 60, True)
    assert tuple(join_completeness(bank.tx, A.by_branch(bank.tx, bank.account).limit(2)).first())[2] is False


def test_branch_report(bank, spark, tmp_path):
    base = str(tmp_path / "report")
    assert sets.same_rows(branch_report.branch_summary(bank), branch_report.branch_summary_sql(bank))
    _, _, credits, debits = groups(EVERYTHING, lambda t: 0)[0]
    done = branch_report.run_branch_report(bank, base)
    assert (done["rows"], done["transaction_count"], done["net_cash_flow"]) == (3, 60, float(credits - debits))

    def content():
        home = f"{base}/{REPORT_OUTPUT}"
        return current_version(spark, home), sorted(r.value for r in spark.read.text(current_csv(spark, home)).collect())

    first = content()
    expected = [f"{b},{n},{float(s)!r},{float(c - d)!r}" for b, (n, s, c, d) in groups(EVERYTHING, branch_of).items()]
    assert [line for line in first[1] if not line.startswith("branch_id")] == sorted(expected)
    branch_report.run_branch_report(bank, base)
    assert content()[1] == first[1] and content()[0] != first[0]
    now = content()
    orphan = transactions(spark, [*EVERYTHING, ("X999", "P99", "2031-03-02", "CREDIT", "1.00")])
    with pytest.raises(DataQualityError, match="Transactions referencing nonexistent accounts: 1"):
        branch_report.run_branch_report(Frames(orphan, bank.account, bank.customer, bank.branch), base)
    assert content() == now


def test_totals_beyond_a_bigint_with_any_session_setting(spark):
    """Sums past 92 quadrillion, exact whether overflow is an error in the session or not."""
    amounts = ["9999999999999999.99", "0.01", "-0.05", "8000000000000000.50"] * 30
    df = spark.createDataFrame([(a,) for a in amounts], "a string").select(F.col("a").cast("decimal(18,2)").alias("amount"))
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for setting in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", setting)
            assert A.grand_total(df).first()[0] == sum(map(Decimal, amounts))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


# --- order-dependent operators against brute force ---


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 20, 3])
def test_running_sum_against_brute_force(spark, rows_per_bucket):
    import random

    rng = random.Random(11)
    # two thirds of the rows share one day
    data = [(f"2026-01-{1 if rng.random() < 0.66 else rng.randrange(1, 29):02d}", f"t'{i}\\", rng.randrange(-500, 500)) for i in range(800)]
    df = spark.createDataFrame(data, "d string, id string, cents long").select(
        F.col("d").cast("date").alias("d"), "id", (F.col("cents") / F.lit(100)).cast("decimal(18,2)").alias("v"))
    got = {r.id: r.total for r in ordered.running_sum(df, ["d", "id"], "v", "total", rows_per_bucket).collect()}
    total, expected = 0, {}
    for d, i, cents in sorted(data):
        total += cents
        expected[i] = total
    assert {k: round(float(v) * 100) for k, v in got.items()} == expected


def test_rank_with_a_hot_value_against_brute_force(spark):
    import random

    rng = random.Random(5)
    data = [(i, 0 if rng.random() < 0.4 else rng.randrange(100)) for i in range(600)] + [(600, None), (601, None)]
    df = spark.createDataFrame(data, "k long, v long")
    got = {r.k: r["rank"] for r in ordered.rank_descending(df, "v", "rank", rows_per_bucket=4).collect()}
    # a missing value ranks behind all others
    assert got == {k: 1 + sum(w is not None and (v is None or w > v) for _, w in data) for k, v in data}


def test_multiset_difference(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert sorted(tuple(r) for r in sets.multiset_difference(a, b).collect()) == [(1, 2, 1), (3, 0, 1)]
    assert sets.same_rows(a, a) and not sets.same_rows(a, b)


def test_synthetic_transactions_are_repeatable(spark, bank):
    made = synthetic_transactions(bank.account, 5000)
    again = synthetic_transactions(bank.account, 5000).repartition(3)
    assert sets.same_rows(made, again)
    facts = made.agg(
        F.countDistinct("transaction_id"), F.countDistinct("account_id"), F.min("amount") >= 1, F.max("amount") <= 5000,
        F.min("transaction_date") >= "2026-01-01", F.max("transaction_date") <= "2026-09-30").first()
    assert tuple(facts) == (5000, 12, True, True, True, True)
