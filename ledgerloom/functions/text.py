"""Text columns: blanks, reasons, records and fingerprints."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space when a value is stripped.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Texts a lenient CSV read treats as "no value".
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

REASON_SEPARATOR = "; "


def strip(col: Column) -> Column:
    """Drop leading and trailing white space of any kind (``trim`` alone drops blanks only).

    Values that begin and end with a character from '!' to '~' need no trimming.
    """
    tidy = _visible(F.ascii(col)) & _visible(F.ascii(F.substring(col, -1, 1)))
    return F.when(tidy, col).otherwise(F.btrim(col, F.lit(WHITE_SPACE)))


def _visible(code: Column) -> Column:
    return code.between(33, 126)


def is_missing(col: Column) -> Column:
    """NULL, empty or only white space; never NULL itself.

    A first character from '!' to '~' settles most values without looking further.
    """
    blank = F.when(_visible(F.ascii(col)), F.lit(False)).otherwise(strip(col) == "")
    return col.isNull() | blank


def na_to_null(col: Column) -> Column:
    """Map the lenient reader's NA texts to NULL."""
    return F.when(~col.isin(NA_TOKENS), col)


def empty_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def clean_upper(col: Column) -> Column:
    return F.upper(strip(col))


def reason_list(rules: Iterable[tuple[str, Column]]) -> Column:
    """Texts of all broken rules, in rule order, as an array."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(text)) for text, broken in rules]))


def broken_mask(rules: Iterable[tuple[str, Column]]) -> Column:
    """Broken rules as bits of an integer, the first rule being bit 0: cheap to carry and test."""
    bits = [F.when(broken, 1 << i).otherwise(0) for i, (_, broken) in enumerate(rules)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def masked_reasons(mask: Column, texts: list[str]) -> Column:
    """Texts of the bits set, looked up four bits at a time; rows without any skip the work."""
    parts = []
    for start in range(0, len(texts), 4):
        some = texts[start : start + 4]
        chosen = [[F.lit(text) for i, text in enumerate(some) if n >> i & 1] for n in range(1 << len(some))]
        table = F.array(*[F.array(*found).cast("array<string>") for found in chosen])
        parts.append(F.get(table, F.shiftright(mask, start).bitwiseAND((1 << len(some)) - 1)))
    return F.when(mask == 0, F.array().cast("array<string>")).otherwise(F.concat(*parts))


def first_reason(rules: Iterable[tuple[str, Column]]) -> Column:
    """Text of the first broken rule, NULL when none is."""
    return F.coalesce(*[F.when(broken, F.lit(text)) for text, broken in rules])


def join_reasons(reasons: Column) -> Column:
    return F.concat_ws(REASON_SEPARATOR, reasons)


def normalize_reasons(text: Column, default: str) -> Column:
    """Split on ';', strip, drop empties; NULL or empty text gives ``default``."""
    filled = F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(text)
    return F.filter(F.transform(F.split(filled, ";"), strip), lambda part: part != "")


def json_record(columns: Iterable[str]) -> Column:
    """The named columns as one JSON object with sorted keys, NULLs kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def fingerprint(*cols: Column) -> Column:
    """Deterministic surrogate id of a natural key."""
    return F.sha2(F.concat_ws("\x1f", *cols), 256)
