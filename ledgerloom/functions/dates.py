"""Date parsing and date parts. All functions give NULL, never an error, on bad text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_date(col: Column) -> Column:
    """A real calendar date written exactly as YYYY-MM-DD."""
    return F.when(col.rlike(r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), col).try_cast("date")


def compact_date(col: Column) -> Column:
    """A real calendar date written as YYYYMMDD."""
    dashed = F.regexp_replace(col, r"^([0-9]{4})([0-9]{2})([0-9]{2})\z", "$1-$2-$3")
    return strict_date(dashed)


def flexible_date(col: Column) -> Column:
    """YYYY-M-D or M/D/YYYY; padding optional.

    The plain date cast reads unpadded ISO dates, so both styles are brought to that order
    instead of going through a formatter.
    """
    iso = F.when(col.rlike(r"^(?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), col)
    parts = F.split(col, "/")
    american = F.when(
        col.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/(?!0000)[0-9]{4}\z"),
        F.concat_ws("-", F.get(parts, 2), F.get(parts, 0), F.get(parts, 1)),
    )
    return F.coalesce(iso, american).try_cast("date")


def date_key(col: Column) -> Column:
    """Date as a yyyymmdd integer."""
    return F.year(col) * 10000 + F.month(col) * 100 + F.dayofmonth(col)


def day_name(col: Column) -> Column:
    return F.date_format(col, "EEEE")
