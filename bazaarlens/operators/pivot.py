"""Long store x month facts to one wide row per store."""

from __future__ import annotations

import datetime as dt
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.dates import months_in
from bazaarlens.functions.formats import short_month

MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def month_label(month: dt.date) -> str:
    return f"{MONTH_NAMES[month.month - 1]} {month.year:04d}"


def pivot_months(long: DataFrame, start: dt.date, end: dt.date, *sheet_keys: str) -> DataFrame:
    """`Store ID`, one zero-filled column per month of the range, and their Total.

    The labels come from the range, so no job runs to find them. A month outside the range adds
    to no column, but its store still gets a row. With sheet_keys, several facts pivot at once.
    """
    labels = [month_label(m) for m in months_in(start, end)]
    keys = [*sheet_keys, "Store ID"]
    wide = (
        long.select(
            *sheet_keys, F.col("store_id").alias("Store ID"), short_month(F.col("sale_month")).alias("label"), "value"
        )
        .groupBy(*keys)
        .pivot("label", labels)
        .agg(F.sum("value"))
        .na.fill(0, labels)
    )
    total = F.expr(" + ".join(f"`{name}`" for name in labels) or "0").cast("decimal(28,2)")
    return wide.select("*", total.alias("Total")).orderBy(*[F.asc_nulls_last(k) for k in keys])
