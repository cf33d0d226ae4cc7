"""Money is DECIMAL(18,2) everywhere: sums are exact and independent of row order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.schemas import MONEY

# Transaction types and currency of the operational model.
CREDIT, DEBIT = "CREDIT", "DEBIT"
TRANSACTION_TYPES = [CREDIT, DEBIT]
CURRENCY = "USD"

# Transaction types of the layered models.
INFLOW_TYPES = ["DEPOSIT"]
OUTFLOW_TYPES = ["PURCHASE", "WITHDRAWAL"]

# Amount bands.
SMALL_BELOW, MEDIUM_UP_TO = "100", "499.99"


def money(col: Column) -> Column:
    """Numeric column as money."""
    return col.cast(MONEY)


def parse_money(col: Column) -> Column:
    """Text as money, rounded half up; NULL when it is no number or does not fit."""
    return col.try_cast(MONEY)


def is_plain_positive(col: Column) -> Column:
    """Plain decimal text above zero, of any length; never NULL.

    A plain decimal is above zero exactly when one of its digits is, so no lossy parse is needed.
    """
    return F.coalesce(col.rlike(r"^(?=[0-9.]*[1-9])[0-9]+(\.[0-9]+)?\z"), F.lit(False))


def is_beyond_money(col: Column) -> Column:
    """Plain decimal text above zero that the money type cannot hold; never NULL."""
    long = F.length(col) > MONEY.precision - MONEY.scale
    return F.coalesce(long & is_plain_positive(col) & parse_money(col).isNull(), F.lit(False))


def cents(col: Column) -> Column:
    """Money as whole cents in a BIGINT, exact for every value.

    Below the bound a double holds the cents exactly; beyond it the slower decimal product is used.
    """
    bound = F.lit(str(10**13)).cast(MONEY)
    return F.when(col.between(-bound, bound), F.floor(col.cast("double") * 100 + 0.5)).otherwise(
        (col * 100).cast("long")
    )


def sum_cents(whole: Column) -> Column:
    """Exact total of a cents column, as money, whatever the session's overflow setting.

    Adding BIGINTs is far cheaper than adding decimals. The cents are cut into three digits of base
    2^20, each summed on its own: no sum can overflow below eight trillion rows.
    """
    low = F.lit((1 << 20) - 1)
    digits = [F.shiftright(whole, 40), F.shiftright(whole, 20).bitwiseAND(low), whole.bitwiseAND(low)]
    total = F.lit(Decimal(0)).cast("decimal(38,0)")
    for i, digit in enumerate(digits):
        scale = F.lit(Decimal(1 << (40 - 20 * i))).cast("decimal(14,0)")
        total = (total + (F.sum(digit).cast("decimal(19,0)") * scale).cast("decimal(36,0)")).cast("decimal(38,0)")
    return (total.cast("decimal(36,0)") * F.lit(Decimal("0.01"))).cast("decimal(30,2)")


def sum_money(col: Column) -> Column:
    """Exact total of a money column."""
    return sum_cents(cents(col))


def signed_amount(kind: Column, amount: Column) -> Column:
    """CREDIT adds, anything else subtracts."""
    return F.when(kind == CREDIT, amount).otherwise(-amount)


def flow_amount(kind: Column, amount: Column) -> Column:
    """Inflows add, outflows subtract, other types have no sign (NULL)."""
    return F.when(kind.isin(INFLOW_TYPES), amount).when(kind.isin(OUTFLOW_TYPES), -amount)


def amount_band(amount: Column) -> Column:
    return (
        F.when(amount < F.lit(SMALL_BELOW).cast(MONEY), "Small")
        .when(amount <= F.lit(MEDIUM_UP_TO).cast(MONEY), "Medium")
        .otherwise("Large")
    )


def _whole(col: Column, digits: int = 0) -> Column:
    return (col * F.lit(10**digits)).cast("decimal(38,0)")


def half_up_quotient(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """``numerator / denominator`` rounded half up to ``digits`` places, exact, NULL on zero.

    Both are decimals with at most two places. Integer arithmetic avoids rounding twice.
    """
    top = _whole(F.abs(numerator), 2) * F.lit(10**digits)
    bottom = _whole(F.abs(denominator), 2)
    twice = (top * 2 + bottom).cast("decimal(38,0)")
    units = F.call_function("div", twice, F.nullif(bottom * 2, F.lit(0).cast("decimal(38,0)")))
    sign = F.when((numerator < 0) != (denominator < 0), F.lit(-1)).otherwise(F.lit(1))
    return ((units * sign).cast("decimal(27,0)") / F.lit(10**digits)).cast(f"decimal(27,{digits})")


def mean_money(total: Column, rows: Column) -> Column:
    """Average of ``rows`` amounts that add up to ``total``, to the cent."""
    return half_up_quotient(total.cast("decimal(30,2)"), rows.cast("decimal(20,2)"))


def percent_of(part: Column, whole: Column) -> Column:
    """Share in percent with two places."""
    return half_up_quotient(part.cast("decimal(30,2)") * 100, whole.cast("decimal(30,2)"))
