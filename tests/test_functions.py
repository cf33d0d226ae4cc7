"""Scalar functions, one table of cases each."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text
from ledgerloom.operators.transforms import at_edge


def evaluate(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in at_edge(df.orderBy("i").select(expression(F.col("v")).alias("x"))).collect()]


def test_is_missing(spark):
    values = [None, "", "   ", "\t\n", " ", " x", "0", "é"]
    assert evaluate(spark, values, text.is_missing) == [True, True, True, True, True, False, False, False]


def test_strip_drops_every_kind_of_white_space(spark):
    assert evaluate(spark, ["\t a b \n", " x "], text.strip) == ["a b", "x"]


def test_na_tokens(spark):
    assert evaluate(spark, ["", "NA", "null", "n/a", "<NA>", "Na", " NA"], text.na_to_null) == [
        None, None, None, None, None, "Na", " NA"]


@pytest.mark.parametrize("value, expected", [
    ("2026-09-06", "2026-09-06"), ("2024-02-29", "2024-02-29"), ("2026-02-30", None), ("2026-04-31", None),
    ("2026-13-06", None), ("2026/09/06", None), ("2026-9-6", None), ("2026-09-06 ", None), ("2026-09-06\n", None),
    ("0000-01-01", None), ("0001-01-01", "0001-01-01"), ("", None), (None, None), ("20260906", None),
])
def test_strict_date(spark, value, expected):
    assert evaluate(spark, [value], dates.strict_date) == [expected]


def test_flexible_date(spark):
    values = ["2026-9-6", "2026-09-06", "9/7/2026", "09/07/2026", "13/1/2026", "2026-02-30", "2/30/2026", "7.9.2026", ""]
    assert evaluate(spark, values, dates.flexible_date) == [
        "2026-09-06", "2026-09-06", "2026-09-07", "2026-09-07", None, None, None, None, None]


def test_compact_date_key_and_day_name(spark):
    assert evaluate(spark, ["20260906", "20261301", "2026"], dates.compact_date) == ["2026-09-06", None, None]
    assert evaluate(spark, ["2026-09-07"], lambda c: dates.date_key(c.cast("date"))) == [20260907]
    assert evaluate(spark, ["2026-09-06", "2026-09-09"], lambda c: dates.day_name(c.cast("date"))) == [
        "Sunday", "Wednesday"]


@pytest.mark.parametrize("value, expected", [
    ("10.00", True), ("120", True), ("0.01", True), ("0.00", False), ("-50.00", False), ("", False), (None, False),
    ("ABC", False), ("1e10", False), ("1,200.00", False), (" 10.00", False), ("10.", False), (".5", False),
    ("00012.50", True), ("12.345", True), ("9999999999999999.99", True), ("99999999999999999", True), ("9" * 30 + ".5", True), ("0" * 40, False), ("+5", False),
])
def test_plain_positive_amount(spark, value, expected):
    assert evaluate(spark, [value], money.is_plain_positive) == [expected]


def test_amounts_beyond_the_money_type(spark):
    values = ["9999999999999999.99", "99999999999999999", "0000000000000000000012.50", "12.3456789012345678901", "x" * 30, None, "9" * 40]
    assert evaluate(spark, values, money.is_beyond_money) == [False, True, False, False, False, False, True]


def test_amount_parse_keeps_scientific_and_drops_non_numbers(spark):
    assert evaluate(spark, ["1e3", "90.005", "inf", "nan", "x"], money.parse_money) == [1000.0, 90.01, None, None, None]


def test_cents_are_exact_also_beyond_double_precision(spark):
    values = ["0.01", "-0.01", "1234567.89", "9999999999999.99", "9999999999999999.99", "-9999999999999999.99", None]
    assert evaluate(spark, values, lambda c: money.cents(c.cast("decimal(18,2)"))) == [
        1, -1, 123456789, 999999999999999, 999999999999999999, -999999999999999999, None]


def test_half_up_means_and_shares(spark):
    def mean(n):
        return lambda c: money.mean_money(c.cast("decimal(38,2)"), F.lit(n))

    assert evaluate(spark, ["665.50", "0.05", "-0.05", "2.00"], mean(2)) == [332.75, 0.03, -0.03, 1.0]
    assert evaluate(spark, ["665.50"], mean(3)) == [221.83]
    assert evaluate(spark, ["1.00"], mean(0)) == [None]
    assert evaluate(spark, ["1200.00"], lambda c: money.percent_of(
        c.cast("decimal(18,2)"), F.lit("3425.50").cast("decimal(18,2)"))) == [35.03]


def test_signs_and_bands(spark):
    amount = F.lit("5.00").cast("decimal(18,2)")
    assert evaluate(spark, ["CREDIT", "DEBIT", "OTHER"], lambda c: money.signed_amount(c, amount)) == [5.0, -5.0, -5.0]
    assert evaluate(spark, ["DEPOSIT", "PURCHASE", "WITHDRAWAL", "FEE"], lambda c: money.flow_amount(c, amount)) == [
        5.0, -5.0, -5.0, None]
    assert evaluate(spark, ["99.99", "100.00", "499.99", "500.00"], lambda c: money.amount_band(
        c.cast("decimal(18,2)"))) == ["Small", "Medium", "Medium", "Large"]


def test_reason_text(spark):
    assert evaluate(spark, ["a; b ;;c", None, "", " ; "], lambda c: text.join_reasons(
        text.normalize_reasons(c, "rejected"))) == ["a; b; c", "rejected", "rejected", ""]


def test_json_record_sorts_keys_and_keeps_nulls(spark):
    df = spark.createDataFrame([("x", None)], "b string, a string")
    assert df.select(text.json_record(["b", "a"])).first()[0] == '{"a":null,"b":"x"}'
