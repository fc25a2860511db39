"""Text forms of months and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_month(col: Column) -> Column:
    """1996-03"""
    return F.date_format(col, "yyyy-MM")


def short_month(col: Column) -> Column:
    """Mar 1996"""
    return F.date_format(col, "MMM yyyy")


def padded_month_name(col: Column) -> Column:
    """March, blank-padded to nine characters."""
    return F.rpad(F.date_format(col, "MMMM"), 9, " ")


def plain_money(col: Column) -> Column:
    """Two decimals, no grouping and no leading zero, at any size: .00, .05, 1234.50."""
    return F.call_function("format_number", F.round(col.cast("decimal(38,10)"), 2), F.lit("#.00"))


def grouped(col: Column, digits: int) -> Column:
    """1,234.50 or 1,235 by the number of digits; halves go away from zero."""
    return F.format_number(F.round(col.cast("decimal(38,10)"), digits), digits)


def is_whole(col: Column) -> Column:
    # Comparing with floor() would widen both decimals past 38 digits and lose the cents.
    return col % 1 == 0


def grouped_by_value(col: Column) -> Column:
    """No decimals for a whole number, two otherwise."""
    return F.when(is_whole(col), grouped(col, 0)).otherwise(grouped(col, 2))
