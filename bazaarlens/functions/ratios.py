"""Guarded ratios and rounding.

Division runs in DOUBLE and the quotient is put back on a ten-digit decimal grid before it is
rounded, so that 0.285 rounds up as it does in exact arithmetic. The guards differ on purpose:
each report says whether an empty denominator means NULL or 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = "decimal(38,10)"


def _double(value: Column) -> Column:
    return value.cast("double")


def rounded(value: Column, digits: int) -> Column:
    """Half away from zero, as DECIMAL."""
    return F.round(value.cast(GRID), digits)


def ratio_or_null(num: Column, den: Column) -> Column:
    """num / den, NULL where den is 0 or NULL."""
    return _double(num) / F.nullif(_double(den), F.lit(0.0))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0, NULL where den is NULL."""
    return F.when(den == 0, F.lit(0.0)).otherwise(ratio_or_null(num, den))


def ratio_if_positive(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0 or below."""
    return F.when(den <= 0, F.lit(0.0)).otherwise(ratio_or_null(num, den))


def percent_or_null(num: Column, den: Column) -> Column:
    return ratio_or_null(F.lit(100.0) * _double(num), den)


def growth(now: Column, before: Column) -> Column:
    """(now - before) / before, 0 where before is 0."""
    return ratio_or_zero(_double(now) - _double(before), before)


def average(total: Column, count: Column) -> Column:
    """Mean from its two mergeable parts; NULL on an empty group."""
    return ratio_or_null(total, count)


def hundredth(total: Column) -> Column:
    """Percent points x money -> money, exact in DECIMAL."""
    return total * F.lit("0.01").cast("decimal(2,2)")


def filled(value: Column, default: int | str = 0) -> Column:
    return F.coalesce(value, F.lit(default))
