"""Personal data in texts: patterns propose spans, checksums confirm them, context words move the score.

Kinds: email, ip, card (Luhn) and phone are always kept once their own test holds; iban needs its
mod-97 checksum, and ssn (three, two and four digits) needs a context word nearby. Only DataFrame
functions run, row by row: no shuffle, and a row's cost follows the length of its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.spans import find, redact

BASE_KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*BASE_KINDS, "iban", "ssn"]

# The patterns of the contract with possessive loops. Each begins where the plain pattern
# would: at the start of a run or where the match before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
CONTEXT = {
    "email": ["mail", "contact", "write to"],
    "ip": ["ip", "address", "host", "server"],
    "card": ["card", "visa", "credit", "payment"],
    "phone": ["phone", "call", "tel", "mobile", "fax"],
    "iban": ["iban", "account", "bank", "transfer"],
    "ssn": ["ssn", "social security"],
}
# score of a bare match, what a checksum adds and what a context word adds
BARE, CHECKED, NEARBY = 0.5, 0.4, 0.2
LEAST_SCORE = 0.5
NEAR_CHARS = 40


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of a text pass the Luhn test; meant for short texts."""
    numbers = F.transform(F.filter(F.split(F.reverse(digits(text)), ""), lambda d: d != ""), lambda d, i: F.struct(d.cast("int").alias("d"), i.alias("i")))
    doubled = F.transform(
        numbers,
        lambda x: F.when(x["i"] % 2 == 0, x["d"]).otherwise(F.when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number passes the mod-97 test."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    values = F.transform(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _keep(kind: str):
    def ip(m: Column) -> Column:
        return F.forall(F.split(m, r"\."), lambda part: F.coalesce(part.try_cast("double"), F.lit(0.0)) <= 255)

    return {
        "email": lambda m: F.lit(True),
        "ip": ip,
        "card": lambda m: F.char_length(digits(m)).between(13, 19) & luhn(m),
        "phone": lambda m: F.char_length(digits(m)).between(9, 15),
        "iban": mod97,
        "ssn": lambda m: F.lit(True),
    }[kind]


def _scored(text: Column, kind: str, spans: Column) -> Column:
    words = CONTEXT[kind]

    def one(s: Column) -> Column:
        start = F.greatest(s["start"] - NEAR_CHARS, F.lit(0))
        near = F.lower(F.substring(text, start + 1, s["end"] - start + NEAR_CHARS))
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(near, F.lit(word))
        score = F.lit(BARE if kind != "ssn" else BARE - NEARBY / 2) + F.lit(CHECKED if kind in ("card", "iban") else 0.0) + F.when(hit, NEARBY).otherwise(0.0)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.least(score, F.lit(1.0)).alias("score"))

    return F.filter(F.transform(spans, one), lambda s: s["score"] >= LEAST_SCORE)


def pii_spans(text: Column) -> Column:
    """All spans by kind as listed, then start: kind, start, end (code points, end exclusive), text, score."""
    maybe = {
        "email": F.contains(text, F.lit("@")),
        "ip": F.contains(text, F.lit(".")),
        "phone": F.contains(text, F.lit("+")),
        "ssn": F.contains(text, F.lit("-")),
    }
    return F.concat(*[_scored(text, kind, find(text, kind, PATTERNS[kind], _keep(kind), maybe.get(kind))) for kind in ALL_KINDS])


def with_pii(docs: DataFrame, text_column: str = "text", out: str = "pii_spans") -> DataFrame:
    """Every row of ``docs`` with its spans in ``out``. A null or empty text has none; repeated rows get equal spans.

    A column named ``out`` that is already there is replaced; all other columns stay.
    """
    return docs.withColumn(out, pii_spans(F.coalesce(F.col(text_column), F.lit(""))))


def redacted(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; a null text stays null."""
    spans = "__pii_spans"
    marked = with_pii(docs, text_column, spans)
    return marked.withColumn(
        text_column, F.when(F.size(spans) > 0, redact(F.col(text_column), F.col(spans))).otherwise(F.col(text_column))
    ).drop(spans)
