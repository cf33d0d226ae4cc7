"""File manifests, delimited files and the delivery check."""

import hashlib
from collections import Counter
from decimal import Decimal

import pytest
from fixtures import HEADER, branch_files, half_up, value_faults, write_lines
from pyspark.sql import functions as F

from ledgerloom.operators import rules as R
from ledgerloom.plans.delivery import check_delivery, files_read, publish_delivery
from ledgerloom.schemas import TRANSACTION_COLUMNS
from ledgerloom.sources.branch_files import Scans, _probe, file_report, read_branch_files
from ledgerloom.sources.delimited import (
    csv_fields,
    daily_rows,
    file_faults,
    number_lines,
    read_lines,
    read_reference_csv,
    strict_rows,
)
from ledgerloom.sources.files import HASHED, NAME_BAD_DATE, NAME_MISMATCH, classify_names, discover, find_branch_files, list_files, with_sha256


def folder_with(tmp_path, files):
    for name, lines in files.items():
        write_lines(tmp_path, name, lines)
    return str(tmp_path)


def file_name_cases():
    """(name, branch, day, reason): a right name of each branch, and the same name with one part spoiled."""
    for number, day in (("7", "20310214"), ("0440", "20280229"), ("123456789", "19991231")):
        right = f"BR{number}_{day}_TRANSACTION.csv"
        yield right, f"BR{number}", f"{day[:4]}-{day[4:6]}-{day[6:]}", None
        for wrong in (right.lower(), right.replace(".csv", ".CSV"), right.replace(f"_{day}", ""), right.replace(day, day[1:]), f"x{right}", f"{right}.bak", right.replace("BR", "BR-")):
            yield wrong, None, None, NAME_MISMATCH
        for never in ("0229" if day[:4] != "2028" else "0230", "0431", "0010", "1200"):
            yield right.replace(day, day[:4] + never), None, None, NAME_BAD_DATE


@pytest.mark.parametrize("name, branch, day, reason", list(file_name_cases()))
def test_file_names(spark, name, branch, day, reason):
    r = classify_names(spark.createDataFrame([(name,)], "filename string")).first()
    assert (r.branch_id, str(r.file_date) if r.file_date else None, r.reason) == (branch, day, reason)


def test_manifest_and_hashes(spark, tmp_path):
    folder = folder_with(tmp_path, {
        "BR002_20260907_TRANSACTION.csv": ["a"], "BR001_20260906_TRANSACTION.csv": ["a"], "notes.txt": ["b"]})
    (tmp_path / "BR003_20260907_TRANSACTION.csv").write_text("")
    (tmp_path / "sub").mkdir()
    write_lines(tmp_path / "sub", "BR009_20260907_TRANSACTION.csv", ["a"])
    got = {r.filename: r for r in discover(spark, folder).collect()}
    assert set(got) == {p.name for p in tmp_path.iterdir() if p.is_file()}
    for name, r in got.items():
        assert r.sha256 == hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()
    assert got["notes.txt"].reason == NAME_MISMATCH
    # files above the limit are hashed as a stream, with the same result
    streamed = {r.filename: r.sha256 for r in with_sha256(spark, folder, whole_file_limit=80).collect()}
    assert streamed == {name: r.sha256 for name, r in got.items()}


def test_hashes_by_line_equal_hashes_of_bytes(spark, tmp_path):
    """Line ends, marks, bytes that are no text and names with signs, whatever way a file is hashed."""
    bodies = [b"", b"\n", b"a", b"a\n", b"\n\n", b"\r\n", b"a\r\nb\r", b"\xef\xbb\xbf", b"\xef\xbb\xbf\n", b"\xef\xbb\xbfa,b\nc", b"\xef\xbb\xbfa\n",
              b"\x00\xff\xfe\n\x80", b"x" * 50_000 + b"\n" + b"y" * 50_000, "ü\u2028\n".encode() * 20_000]
    for i, body in enumerate(bodies):
        (tmp_path / f"f {i} [{i}]%20.csv").write_bytes(body)
    expected = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        for limit in (0, 10, 1 << 30):
            assert {r.filename: r.sha256 for r in with_sha256(spark, str(tmp_path), whole_file_limit=limit).collect()} == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_known_files_are_not_opened(spark, tmp_path):
    folder = folder_with(tmp_path, {"a.csv": ["1"], "b.csv": ["2"]})
    first = with_sha256(spark, folder).cache()
    true = {r.filename: r.sha256 for r in first.collect()}
    known = spark.createDataFrame([(r.path, r.length, r.modified, f"known {r.filename}") for r in first.collect()], HASHED)
    write_lines(tmp_path, "c.csv", ["3"])
    got = {r.filename: r.sha256 for r in with_sha256(spark, folder, known=known).collect()}
    # what is remembered is taken as it is; only the new file was hashed
    assert got == {"a.csv": "known a.csv", "b.csv": "known b.csv", "c.csv": hashlib.sha256((tmp_path / "c.csv").read_bytes()).hexdigest()}
    write_lines(tmp_path, "a.csv", ["changed"])
    got = {r.filename: r.sha256 for r in with_sha256(spark, folder, known=known).collect()}
    assert got["a.csv"] not in (true["a.csv"], "known a.csv") and got["b.csv"] == "known b.csv"


def test_no_branch_files(spark, tmp_path):
    write_lines(tmp_path, "notes.txt", ["x"])
    with pytest.raises(FileNotFoundError, match="No branch transaction files found"):
        find_branch_files(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        list_files(spark, str(tmp_path / "nowhere"))


def test_csv_fields(spark):
    lines = ["a,b,c", "a,,", ",a", '"1,200.00",x', '"say ""hi""",y', 'x,"a,b"', "one", '"a"b,c', '""']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, v string")
    got = [r.f for r in df.orderBy("i").select(csv_fields(F.col("v")).alias("f")).collect()]
    assert got == [["a", "b", "c"], ["a", "", ""], ["", "a"], ["1,200.00", "x"], ['say "hi"', "y"], ["x", "a,b"],
                   ["one"], ["ab", "c"], [""]]


def test_row_numbers_over_many_splits(spark, tmp_path):
    lines = ["" if i % 100 == 7 else f"T{i},A{i},2026-09-06,CREDIT,{i}.00,USD" for i in range(20_000)]
    write_lines(tmp_path, "BR001_20260906_TRANSACTION.csv", lines)
    write_lines(tmp_path, "BR002_20260906_TRANSACTION.csv", lines[:30])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        read = read_lines(spark, [str(p) for p in tmp_path.iterdir()])
        assert read.select("source_filename", "block").distinct().count() > 8
        numbered = number_lines(read).filter("record_number is not null").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, expected in [("BR001_20260906_TRANSACTION.csv", lines), ("BR002_20260906_TRANSACTION.csv", lines[:30])]:
        mine = sorted((r for r in numbered if r.source_filename == name), key=lambda r: r.record_number)
        assert [r.line for r in mine] == [v for v in expected if v]
        assert [r.record_number for r in mine] == list(range(1, len(mine) + 1))
        assert [r.line_number for r in mine] == [i + 2 for i, v in enumerate(expected) if v]


def test_strict_rows(spark, tmp_path):
    good, bad, short, empty = (f"BR00{i}_20260906_TRANSACTION.csv" for i in (1, 2, 3, 4))
    (tmp_path / good).write_bytes(
        ("﻿" + HEADER.replace("amount", " amount ") + "\r\nT1,A1,d,c,,USD\r\n\r\n T2 ,A1,d,c,\"1,2\",USD").encode())
    write_lines(tmp_path, bad, ["x,y"], header="wrong,header")
    write_lines(tmp_path, short, ["T1,A1,d,c,1,USD", "", "T2,A1,d,c,1"])
    (tmp_path / empty).write_text("")
    files = list_files(spark, str(tmp_path))
    rows, findings = strict_rows(spark, [r.path for r in files.collect()])
    mine = rows.filter(F.col("source_filename") == good).orderBy("source_row_number").collect()
    assert [tuple(r)[1:] for r in mine] == [(1, "T1", "A1", "d", "c", "", "USD"), (2, " T2 ", "A1", "d", "c", "1,2", "USD")]
    got = {r.filename: (r.source_rows, r.error) for r in file_faults(files, findings).collect()}
    assert got[good] == (2, None)
    assert got[bad][1] == f"{bad}: header does not match {HEADER}"
    assert got[short] == (2, f"{short}: data row 2 has 5 fields, expected 6")
    assert got[empty] == (0, f"{empty}: file is empty")


def test_quoted_line_breaks(spark, tmp_path):
    """Values that span lines, also over file blocks, and quotes that open nothing."""
    lines, expected = [], []
    for i in range(3000):
        if i % 50 == 3:
            lines += [f'"T{i}', '', f'x",A1,d,c,{i},USD']
            expected.append([f"T{i}\n\nx", "A1", "d", "c", str(i), "USD"])
        else:
            lines.append(f"T{i},A1,d,c,{i},USD")
            expected.append([f"T{i}", "A1", "d", "c", str(i), "USD"])
    write_lines(tmp_path, "BR001_20260906_TRANSACTION.csv", lines)
    write_lines(tmp_path, "BR002_20260906_TRANSACTION.csv", ['5" pipe,A1,d,c,1,USD', 'T2,A1,d,c,2,USD'])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows, findings = strict_rows(spark, [str(p) for p in tmp_path.iterdir()])
        got = sorted((r.source_filename[:5], r.source_row_number, list(r)[2:]) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r[2] for r in got if r[0] == "BR001"] == expected
    assert [r[1] for r in got if r[0] == "BR001"] == list(range(1, 3001))
    assert [r[2][0] for r in got if r[0] == "BR002"] == ['5" pipe', "T2"]
    assert all(r.error is None for r in findings.collect())
    write_lines(tmp_path, "BR003_20260906_TRANSACTION.csv", ['"T1,A1,d,c,1,USD'] + ["x" * 1000] * 140)
    write_lines(tmp_path, "BR004_20260906_TRANSACTION.csv", ['T1,A1,d,c,1,"' + "y" * 140_000 + '"'])
    faults = {r.source_filename[:5]: r.error for r in strict_rows(spark, [str(p) for p in tmp_path.iterdir()])[1].collect()}
    assert faults["BR001"] is None and faults["BR002"] is None
    # one fault for a value too long, on one line or on several
    assert all(faults[b].endswith(": field larger than field limit (131072)") for b in ("BR003", "BR004"))


@pytest.mark.parametrize("broken_line", [False, True])
def test_branch_values_of_any_length(spark, tmp_path, broken_line):
    """A value of 140,000 characters is read, whether or not another row has a line break in quotes."""
    long = "v" * 140_000
    second = '"a\nb"' if broken_line else "ab"
    write_lines(tmp_path, "BR001_20310214_TRANSACTION.csv", [f"{long},A1,d,CREDIT,1,USD", f"{second},A2,d,CREDIT,2,USD"])
    rows, report = read_branch_files(spark, str(tmp_path))
    assert sorted(r.transaction_id for r in rows.collect()) == sorted([long, second.strip('"')])
    assert [r.error for r in report.collect()] == [None]


def test_records_of_many_long_values(spark, tmp_path):
    """Seventy values just below the limit over several lines are a sound record; one beyond it is not."""
    names = [f"c{i}" for i in range(70)]
    values = [f"{i}\n" + "x" * 124_990 for i in range(70)]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join(f'"{v}"' for v in values) + "\n")
    row = read_reference_csv(spark, str(tmp_path / "wide.csv"), names).first()
    assert [row[n] for n in names] == values and row["row_issues"] == []


def test_daily_file_with_a_long_value_is_its_own_fault(spark, tmp_path):
    write_lines(tmp_path, "transactions_20310214.csv", ["T1,A1,d,CREDIT,1,USD", "T2,A1,d,CREDIT,2,USD"])
    write_lines(tmp_path, "transactions_20310215.csv", ["T3,A1,d,CREDIT,1,USD", f"{'y' * 140_000},A1,d,CREDIT,2,USD"])
    rows, findings = daily_rows(spark, [str(p) for p in tmp_path.iterdir()])
    assert sorted((r.source_file, r.row_no, r.transaction_id) for r in rows.collect()) == [
        ("transactions_20310214.csv", 1, "T1"), ("transactions_20310214.csv", 2, "T2")]
    errors = {r.source_filename: (r.source_rows, r.error) for r in findings.collect()}
    assert errors == {
        "transactions_20310214.csv": (2, None),
        "transactions_20310215.csv": (2, "data row 2: field larger than field limit (131072)")}


def test_long_quoted_values_and_their_line_ends(spark, tmp_path):
    """Values of 100,000 characters, thirty thousand doubled quotes, and line ends inside quotes as delivered."""
    values = ["v" * 100_000, '"' * 30_000, "a\r\nb", "a\nb", ",", "plain"]
    body = "\r\n".join([HEADER, *[",".join(['"' + v.replace('"', '""') + '"', "A1", "d", "c", str(i), "USD"]) for i, v in enumerate(values)]])
    (tmp_path / "BR001_20260906_TRANSACTION.csv").write_bytes(body.encode())
    rows, findings = strict_rows(spark, [str(tmp_path / "BR001_20260906_TRANSACTION.csv")])
    assert [r.transaction_id for r in rows.orderBy("source_row_number").collect()] == values
    assert [(r.source_rows, r.error) for r in findings.collect()] == [(len(values), None)]


def test_reference_rows(spark, tmp_path):
    write_lines(tmp_path, "r.csv", [" C1 , Ann ,x", "", ",,", "C2,Bob", "C3,Cy,y,more,most"], header=" id,name,extra ")
    got = read_reference_csv(spark, str(tmp_path / "r.csv"), ["id", "name"]).orderBy("source_row_number").collect()
    assert [(r.source_row_number, r.id, r.name, r.extra, r._extra_values, r.row_issues) for r in got] == [
        (2, "C1", "Ann", "x", None, []),
        (5, "C2", "Bob", "", None, ["row has 2 values; expected 3"]),
        (6, "C3", "Cy", "y", ["more", "most"], ["row has 5 values; expected 3"]),
    ]
    for header, message in [("id,", "empty column name"), ("id,id,name", "duplicate column names"),
                            ("id", r"missing required columns: \['name'\]")]:
        write_lines(tmp_path, "bad.csv", ["1"], header=header)
        with pytest.raises(ValueError, match=message):
            read_reference_csv(spark, str(tmp_path / "bad.csv"), ["id", "name"])
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="empty or has no header"):
        read_reference_csv(spark, str(tmp_path / "none.csv"), ["id"])


# --- delivery checks against the ledger ---


def judged(files):
    """Per row (file, place): reasons of a delivery in which every copy of a repeated id is invalid."""
    ids = Counter(row[0] for lines in files.values() for row in lines if row[0])
    return {
        (name, place): value_faults(row) + [R.REPEATED_ID] * (ids[row[0]] > 1)
        for name, lines in files.items()
        for place, row in enumerate(lines)
    }


@pytest.mark.parametrize("seed, extra", [(3, {}), (4, {"BR9_20310301_TRANSACTION.csv": []}), (5, {"BR9_20310301_TRANSACTION.csv": [("W1", "P01", "2031-03-01", "CREDIT", "1,200.00", "USD")]})])
def test_deliveries(spark, tmp_path, seed, extra):
    files = {**branch_files(seed), **extra}
    source = tmp_path / "in"
    source.mkdir()
    folder = folder_with(source, {**files, "other.csv": ["x"]})
    reasons = judged(files)
    bad = [r for r in reasons.values() if r]
    for _ in range(2):  # a rerun replaces the outputs
        delivery = check_delivery(spark, folder)
        publish_delivery(delivery, str(tmp_path / "out"))
    told = Counter((r.source_file, r.error_reason) for r in delivery.validated.collect())
    assert told == Counter((name, "; ".join(r)) for (name, _), r in reasons.items())
    invalid = spark.read.csv(str(tmp_path / "out" / "invalid_transactions.csv"), header=True)
    valid = spark.read.csv(str(tmp_path / "out" / "valid_transactions.csv"), header=True)
    assert (invalid.count(), valid.count()) == (len(bad), len(reasons) - len(bad))
    assert Counter(r.error_reason for r in invalid.collect()) == Counter("; ".join(r) for r in bad)
    figures = {
        "files_discovered": len(files), "files_successfully_read": len(files), "files_rejected_or_skipped": 0,
        "total_input_records": len(reasons), "valid_records": len(reasons) - len(bad), "invalid_records": len(bad),
        "rejection_rate_percent": half_up(Decimal(100 * len(bad)) / len(reasons)),
        "duplicate_transaction_count": sum(R.REPEATED_ID in r for r in bad),
        **{f"records_from_{name}": len(lines) for name, lines in files.items()},
        **{f"invalid_reason: {text}": n for text, n in Counter(t for r in bad for t in r).items()},
    }
    written = spark.read.csv(str(tmp_path / "out" / "DQsummary.csv"), header=True)
    assert {r.metric: r.value for r in written.collect()} == {k: str(v) for k, v in figures.items()}
    counts = {r.file: r.row_count for r in files_read(delivery.validated, delivery.files).collect()}
    assert counts == {name: len(lines) for name, lines in files.items()}


def test_file_faults_do_not_stop_good_files(spark, tmp_path):
    write_lines(tmp_path, "BR006_20260906_TRANSACTION.csv", ["T1,A1,2026-09-06,CREDIT,300.00"],
                header="transaction_id,account_id,transaction_date,transaction_type,amount")
    write_lines(tmp_path, "BR012_20260906_TRANSACTION.csv", ["USD,500.00,CREDIT,2026-09-06,A12001,T12001"],
                header="currency,amount,transaction_type,transaction_date,account_id,transaction_id")
    write_lines(tmp_path, "BR013_20260906_TRANSACTION.csv", ["T2,NA,2026-09-06,CREDIT,1.00,USD,note", "T3,A1"],
                header=HEADER + ",memo")
    write_lines(tmp_path, "BR014_20260906_TRANSACTION.csv", ["T4,A1,2026-09-06,CREDIT,1.00,USD,surplus"])
    write_lines(tmp_path, "BR015_20260906_TRANSACTION.csv", ['T5,A1,2026-09-06,CREDIT,1.00,"US', 'D"'])
    write_lines(tmp_path, "BR017_20260906_TRANSACTION.csv", ['T6,A1,2026-09-06,CREDIT,1.00,"US', 'D"', "T7,A1,2026-09-06,CREDIT,1.00,USD,surplus"])
    (tmp_path / "BR016_20260906_TRANSACTION.csv").write_text("")
    rows, report = read_branch_files(spark, str(tmp_path))
    errors = {r.file[:5]: r.error for r in report.collect()}
    assert errors == {
        "BR006": "Missing required column(s): currency", "BR012": None, "BR013": None,
        "BR014": "Could not read file: Expected 6 fields, saw 7", "BR015": None,
        "BR016": "Could not read file: No columns to parse from file",
        "BR017": "Could not read file: Expected 6 fields, saw 7"}
    got = {r.transaction_id: r for r in rows.collect()}
    assert [got["T12001"][c] for c in TRANSACTION_COLUMNS] == ["T12001", "A12001", "2026-09-06", "CREDIT", "500.00", "USD"]
    assert got["T2"].account_id is None and got["T2"].memo == "note" and got["T12001"].memo is None
    assert got["T3"].currency is None
    assert got["T5"].currency == "US\nD"


def test_no_readable_file(spark, tmp_path):
    write_lines(tmp_path, "BR006_20260906_TRANSACTION.csv", ["1"], header="only")
    assert file_report(spark, str(tmp_path)).count() == 1
    with pytest.raises(ValueError, match="No branch files could be read"):
        read_branch_files(spark, str(tmp_path))


def test_row_numbers_move_no_line(spark, tmp_path):
    """Files without empty lines are numbered from their blocks' first places; only blocks with gaps are sorted."""
    lines = [f"T{i},P01,2031-03-01,CREDIT,{i}.00,USD" for i in range(1, 400)]
    gaps = [x for i, line in enumerate(lines) for x in ([line, ""] if i % 50 == 0 else [line])]
    plain, gapped = tmp_path / "plain", tmp_path / "gapped"
    for folder, held in ((plain, {"a.csv": lines, "b.csv": lines[:7]}), (gapped, {"a.csv": lines, "b.csv": gaps})):
        folder.mkdir()
        for name, rows in held.items():
            (folder / name).write_text("\n".join([HEADER, *rows]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for folder, longest in ((plain, 7), (gapped, 399)):
            rows, findings = strict_rows(spark, [str(p) for p in folder.glob("*.csv")])
            got = rows.select("source_filename", "source_row_number", "transaction_id").collect()
            wanted = {(n, i, f"T{i}") for n, most in (("a.csv", 399), ("b.csv", longest)) for i in range(1, most + 1)}
            assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted
            assert {(r.source_filename, r.source_rows, r.error) for r in findings.collect()} == {("a.csv", 399, None), ("b.csv", longest, None)}
            if folder is plain:
                plan = rows._jdf.queryExecution().executedPlan().toString()
                assert "Window" not in plan and "hashpartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_long_files_are_delivered_alike(spark):
    """A file whose rows are sorted by several tasks holds the same bytes as one sorted by one task."""
    from pathlib import Path

    from ledgerloom.catalog.files import deliver

    i = F.col("id")
    odd = F.when(i % 11 == 0, " T1 ").when(i % 11 == 1, "#2.5-/_").when(i % 11 == 2, "a\x01b").when(i % 5 == 0, None).when(i % 5 == 1, "").when(i % 5 == 2, 'a "q", x').when(i % 5 == 3, " l\nm ").otherwise("z")
    rows = spark.range(9000).select(
        F.when(i % 4 == 3, "short.csv").otherwise(F.concat(F.lit("long "), (i % 2).cast("string"), F.lit(",.csv"))).alias("file"),
        ((i * 7919) % 9001).alias("place"), odd.alias("text"), F.when(i % 7 > 0, i).cast("string").alias("number"))
    whole, cut = (deliver(rows, "file", ["place"], ["text", "number"], n) for n in (100_000, 2_500))
    found = [{p.name: p.read_text() for p in Path(folder).glob("*.csv")} for folder in (whole, cut)]
    assert found[0] == found[1] and set(found[0]) == {"short.csv", "long 0,.csv", "long 1,.csv"}
    everything = deliver(rows, "file", ["place"], ["text", "number"], 0)
    assert {p.name: p.read_text() for p in Path(everything).glob("*.csv")} == found[0]


def many_branch_files(folder, files=40):
    head = ",".join(TRANSACTION_COLUMNS)
    for i in range(files):
        (folder / f"BR{i}_20260101_TRANSACTION.csv").write_text(f"{head}\nT{i},A,2026-01-01,CREDIT,{i}.00,USD\n")
    (folder / "BR900_20260101_TRANSACTION.csv").write_text("")
    (folder / "BR901_20260101_TRANSACTION.csv").write_text("\n\n\ufeffa,b\n1,2\n")
    (folder / "BR902_20260101_TRANSACTION.csv").write_text(f'{head}\nQ,"x\ny",2026-01-01,DEBIT,1,USD\n')
    (folder / "BR903_20260101_TRANSACTION.csv").write_text(f"\ufeff{head}\nW,A,2026-01-01,DEBIT,1,USD,more\n")
    (folder / "BR904_20260101_TRANSACTION.csv").write_text(f"\n{head},note\ntransaction_id,A,2026-01-01,DEBIT,1,USD,n\n")
    (folder / "BR905_20260101_TRANSACTION.csv").write_text(f"1,2\n{head}\n")
    (folder / "BR9 6_20260101_TRANSACTION.csv").write_text(f"{head}\nS,A,2026-01-01,DEBIT,1,USD\n")
    (folder / "other.csv").write_text(f"{head}\nO,A,2026-01-01,DEBIT,1,USD\n")


def test_many_branch_files_are_listed_by_their_folder(spark, tmp_path):
    many_branch_files(tmp_path)
    spark.sparkContext.setJobGroup("many-files", "")
    try:
        rows, report = read_branch_files(spark, str(tmp_path))
        got = sorted(r.transaction_id for r in rows.select("transaction_id").collect())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == sorted([*(f"T{i}" for i in range(40)), "Q", "transaction_id"])
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("many-files") for s in tracker.getJobInfo(j).stageIds]
    # one task for each path would be the listing of the paths
    tasks = [info.numTasks for info in map(tracker.getStageInfo, stages) if info is not None]
    assert tasks and max(tasks) < 40
    errors = {r.file: r.error for r in report.filter("error IS NOT NULL").collect()}
    missing = "Missing required column(s): " + ", ".join(TRANSACTION_COLUMNS)
    assert errors == {
        "BR900_20260101_TRANSACTION.csv": "Could not read file: No columns to parse from file",
        "BR901_20260101_TRANSACTION.csv": missing,
        "BR903_20260101_TRANSACTION.csv": "Could not read file: Expected 6 fields, saw 7",
        "BR905_20260101_TRANSACTION.csv": "Could not read file: Expected 2 fields, saw 6",
        "BR9 6_20260101_TRANSACTION.csv": "Could not read file: No columns to parse from file",
    }
    heads = {r.file: r.header for r in report.collect()}
    assert heads["BR901_20260101_TRANSACTION.csv"] == "a,b" and heads["BR905_20260101_TRANSACTION.csv"] == "1,2"
    assert heads["BR903_20260101_TRANSACTION.csv"] == ",".join(TRANSACTION_COLUMNS)


def test_scans_by_folder_see_the_files_of_scans_by_path(spark, tmp_path):
    many_branch_files(tmp_path, 5)
    found = find_branch_files(spark, str(tmp_path))
    paths = [r.path for r in found.select("path").collect()]
    for some in (paths, paths[:2], paths[:-1]):
        one, two = (
            sorted(r.value for r in Scans(spark, str(tmp_path), found, n).read(some, lambda reader, at: reader.text(at)).collect())
            for n in (0, 100)
        )
        assert one == two
    (tmp_path / "year=1").mkdir()
    (tmp_path / "year=1" / "BR1_20260101_TRANSACTION.csv").write_text("deep\n")
    assert Scans(spark, str(tmp_path), found, 0).read(paths, lambda reader, at: reader.text(at)).columns == ["value"]


def test_probing_lines_sorts_none_of_them(spark, tmp_path):
    many_branch_files(tmp_path, 2)
    found = find_branch_files(spark, str(tmp_path))
    probe = _probe(Scans(spark, str(tmp_path), found), [r.path for r in found.collect()])
    scanned = probe._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in scanned[scanned.index("HashAggregate") :]
