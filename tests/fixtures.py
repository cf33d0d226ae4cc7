"""An invented bank, made by rule, and a plain-Python ledger that says what every row should give."""

import random
from collections import defaultdict
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import rules as R
from ledgerloom.operators.transforms import at_edge
from ledgerloom.plans.operational import Frames
from ledgerloom.schemas import ACCOUNT, BRANCH, CUSTOMER, TRANSACTION_COLUMNS

HEADER = ",".join(TRANSACTION_COLUMNS)
CENT = Decimal("0.01")
KINDS = ("CREDIT", "DEBIT")
TOWNS = [("N10", "Harbour", "Oslo", "East"), ("N20", "Market", "Bergen", "West"), ("N30", "Hill", "Tromso", "North"), ("N40", "Mill", "Bodo", "North")]
SEGMENTS = ("HOME", "TRADE", "CORP")

CUSTOMERS = [(f"K{i:02d}", f"Holder {chr(64 + i)}", f"k{i}@bank.example", SEGMENTS[i % 3]) for i in range(1, 8)]
BRANCHES = list(TOWNS)
# P12 never has a transaction, nor has branch N40
ACCOUNTS = [
    (f"P{i:02d}", CUSTOMERS[(i * 5) % 7][0], BRANCHES[i % 3][0], ("CURRENT", "DEPOSIT")[i % 2], "OPEN") for i in range(1, 13)
]
START = date(2031, 3, 1)


def _made():
    rng = random.Random(20)
    out = []
    for i in range(1, 61):
        day = START + timedelta(days=rng.randrange(4) if i > 22 else 0)
        account = ACCOUNTS[rng.choice([0, 0, 0, *range(11)])][0]
        out.append((f"X{i:03d}", account, str(day), rng.choice(KINDS), f"{rng.randrange(1, 90000) / 100:.2f}"))
    return out


EVERYTHING = _made()
FIRST_DAY = [t for t in EVERYTHING[:22]]


# --- what a plain ledger makes of rows ---


def half_up(value):
    return Decimal(value).quantize(CENT, ROUND_HALF_UP)


def real_day(text):
    try:
        return len(text or "") == 10 and str(date.fromisoformat(text)) == text
    except ValueError:
        return False


def positive(text):
    whole, _, places = (text or "").partition(".")
    plain = whole.isascii() and whole.isdigit() and (places.isascii() and places.isdigit() or "." not in text)
    return bool(plain) and Decimal(text) > 0


def blank(text):
    return text is None or not text.strip()


def value_faults(row):
    """Reasons of one row by the rules that look at one value, in rule order."""
    tid, account, day, kind, amount, currency = row
    checks = [
        (R.ID_MISSING, blank(tid)), (R.ACCOUNT_MISSING, blank(account)), (R.BAD_DATE, not real_day(day)),
        (R.BAD_TYPE, kind not in KINDS), (R.BAD_AMOUNT, not positive(amount)), (R.BAD_CURRENCY, currency != "USD"),
    ]
    return [text for text, broken in checks if broken]


class Ledger:
    """Accepts rows in delivery order; the first acceptable row of an id wins for good."""

    def __init__(self, known):
        self.known, self.accepted, self.rejected = set(known), {}, []

    def judge(self, row):
        reasons = value_faults(row)
        if not blank(row[1]) and row[1] not in self.known:
            reasons.append(R.UNKNOWN_ACCOUNT)
        if not blank(row[0]) and row[0] in self.accepted:
            reasons.append(R.ALREADY_ACCEPTED)
        if not reasons:
            self.accepted[row[0]] = row
        return reasons

    def deliver(self, files):
        """Files of one run: name -> rows. Returns accepted and rejected counts."""
        good = bad = 0
        for name in sorted(files, key=lambda n: (n.split("_")[1], n.split("_")[0], n)):
            for place, row in enumerate(files[name], 1):
                reasons = self.judge(row)
                if reasons:
                    bad += 1
                    self.rejected.append((name, place, row[0], "; ".join(reasons)))
                else:
                    good += 1
                    self.accepted[row[0]] = (*row, name, place)
        return good, bad

    def gold(self):
        groups = defaultdict(lambda: [0, Decimal(0)])
        for row in self.accepted.values():
            group = groups[row[6].split("_")[0], row[2], row[3]]
            group[0] += 1
            group[1] += half_up(row[4])
        return sorted((*key, n, float(total)) for key, (n, total) in groups.items())


FAULTY = {
    0: ["", "  "], 1: ["", " ", "P99"], 2: ["2031-02-29", "2031/03/01", "2031-3-1", "", "20310301"],
    3: ["credit", "FEE", ""], 4: ["", "0", "-1.00", "1e3", "abc", "0.00", "1,000.00", "+5"], 5: ["usd", "NOK", ""],
}


def spoiled(rng, row, columns):
    row = list(row)
    for c in columns:
        row[c] = rng.choice(FAULTY[c])
    return tuple(row)


def branch_files(seed, days=3, branches=("BR1", "BR2", "BR30"), rows=9):
    """Deliveries by name: rows with repeats over files and days and with every fault."""
    rng = random.Random(seed)
    files, used = {}, []
    for d in range(days):
        for b in branches:
            day = START + timedelta(days=d)
            out = []
            for _ in range(rows):
                tid = rng.choice(used) if used and rng.random() < 0.2 else f"T{seed}{len(used):03d}"
                used.append(tid)
                row = (tid, rng.choice(ACCOUNTS)[0], str(day - timedelta(days=rng.random() < 0.2)), rng.choice(KINDS), f"{rng.randrange(1, 5000)}.{rng.randrange(100):02d}", "USD")
                columns = [c for c in range(6) if rng.random() < 0.08]
                out.append(spoiled(rng, row, columns))
            files[f"{b}_{day:%Y%m%d}_TRANSACTION.csv"] = out
    return files


# --- frames and files ---


def transactions(spark, rows):
    text = spark.createDataFrame([(*r[:5], "USD") for r in rows], ", ".join(f"{c} string" for c in TRANSACTION_COLUMNS))
    return text.withColumns(
        {"transaction_date": F.col("transaction_date").cast("date"), "amount": F.col("amount").cast("decimal(18,2)")}
    )


def bank(spark, rows=None):
    return Frames(
        tx=transactions(spark, rows or EVERYTHING),
        account=spark.createDataFrame(ACCOUNTS, ACCOUNT),
        customer=spark.createDataFrame(CUSTOMERS, CUSTOMER),
        branch=spark.createDataFrame(BRANCHES, BRANCH),
    )


def write_lines(folder, name, lines, header=HEADER):
    """A file with an optional header and a final newline; rows may be tuples of values."""
    body = ([header] if header else []) + [line if isinstance(line, str) else ",".join(quoted(v) for v in line) for line in lines]
    (folder / name).write_text("\n".join(body) + "\n", encoding="utf-8", newline="")


def quoted(value):
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\n\r') else value


def rows(df):
    """Collected rows as tuples: decimals as floats, dates as text."""
    return [tuple(r) for r in at_edge(df).collect()]
