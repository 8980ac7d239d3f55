"""Row derivations: text, money and date columns computed from other columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Surcharge on the plain share of the principal, and the length
# of a month in the maturity rule.
INSTALMENT_PERCENT = 115
DAYS_PER_MONTH = 30
LOWEST_RATE = "0.100"


def truncated(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def labelled(kind: Column, detail: Column) -> Column:
    """``Deposit: Salary`` from ``deposit`` and ``Salary``."""
    return F.concat(F.initcap(kind), F.lit(": "), detail)


def site_url(name: Column, dropped: str = " ,") -> Column:
    """Web address made from a name: lower case, without the dropped characters."""
    slug = F.translate(F.lower(name), dropped, "")
    return F.concat(F.lit("https://"), slug, F.lit(".example.com"))


def json_object(**fields: Column) -> Column:
    """JSON text of the named values, in the order given; NULLs stay visible."""
    parts = F.struct(*[value.alias(name) for name, value in fields.items()])
    return F.to_json(parts, {"ignoreNullFields": "false"})


def money(value: Column, scale: int = 2) -> Column:
    """Round to cents, ties to the even neighbour.

    The value becomes a decimal first: rounding a double would decide ties by
    its binary representation.
    """
    return F.bround(value.cast("decimal(38,18)"), scale)


def lowered(text: Column) -> Column:
    return F.lower(text)


def instalment(principal: Column, months: Column) -> Column:
    """Monthly payment: the principal's share per month plus the surcharge.

    Everything is multiplied out before a single division, so that exact ties
    stay exact and round to even.
    """
    raised = principal.cast("decimal(17,2)") * F.lit(INSTALMENT_PERCENT).cast("decimal(3,0)")
    divisor = months.cast("decimal(5,0)") * F.lit(100).cast("decimal(3,0)")
    return F.bround(raised / divisor, 2).cast("decimal(15,2)")


def maturity(start: Column, months: Column) -> Column:
    return F.date_add(start.cast("date"), (months * DAYS_PER_MONTH).cast("int"))


def at_least(value: Column, lowest: Column) -> Column:
    return F.greatest(value, lowest)


def only_when(condition: Column, value: Column) -> Column:
    """The value where the condition holds, NULL elsewhere."""
    return F.when(condition, value)
