"""Spans of pattern matches in code points, with DataFrame functions only.

Matches are leftmost and do not overlap. A text is split at the matches; the lengths of gaps and
matches, added up in one pass, give every position. Texts without a match stop at one test.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,text:string>"
SPANS = f"array<{SPAN}>"


def find(text: Column, kind: str, pattern: str, keep: Callable[[Column], Column], maybe: Column | None = None) -> Column:
    """Spans of the matches for which ``keep(match)`` holds, in order.

    ``maybe`` is a cheap test without which no match is possible. Possessive patterns only for
    repeated groups: the regex engine recurses on the others.
    """
    none = F.array().cast(SPANS)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(matches, F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), F.char_length(gap).alias("gap")))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(F.char_length(x["m"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("text"))
        found = F.when(x["m"].isNotNull() & keep(x["m"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), found.alias("spans"))

    first = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    found = F.aggregate(parts, first, step, lambda state: state["spans"])
    test = F.rlike(text, F.lit(pattern))
    return F.when(test if maybe is None else maybe & test, found).otherwise(none)


def digest(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap become one mark."""
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        before = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], F.array(before, mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    rest = F.aggregate(
        ordered, first, step, lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.char_length(text)))
    )
    return F.when(F.size(spans) > 0, rest).otherwise(text)
