"""Money kept from one calendar month to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous_month(monthly: DataFrame, key: str, month: str = "month") -> DataFrame:
    """Add `retained`: the key was also active in the calendar month right before.

    Expects one row per key and month. A NULL key is never retained.
    """
    before = F.lag(month).over(Window.partitionBy(key).orderBy(month))
    retained = F.col(key).isNotNull() & (before == F.add_months(F.col(month), -1))
    return monthly.withColumn("retained", F.coalesce(retained, F.lit(False)))


def with_month_before(totals: DataFrame, value: str, name: str, month: str = "month") -> DataFrame:
    """Put the value of the calendar month before next to each month, as `name`.

    The input has one row per month. Each row hands its value to the next month, which takes one
    pass, where a self-join would compute everything below it twice. A month that only got a
    value handed over has NULL measures.
    """
    others = [c for c in totals.columns if c != month]
    kind = {f.name: f.dataType for f in totals.schema.fields}

    def empty(column: str) -> Column:
        return F.lit(None).cast(kind[column])

    own = F.struct(month, *others, empty(value).alias(name))
    next_month = F.add_months(F.col(month), 1).alias(month)
    handed = F.struct(next_month, *[empty(c).alias(c) for c in others], F.col(value).alias(name))
    rows = totals.select(F.explode(F.array(own, handed)).alias("r")).select("r.*")
    return (
        rows.where(F.col(month).isNotNull())
        .groupBy(month)
        .agg(*[F.max(c).alias(c) for c in [*others, name]])
    )


def retained_sum(value: Column) -> Column:
    """Sum over the keys that were also active the month before; NULL when there is none."""
    return F.sum(F.when(F.col("retained"), value))


def gmv_retention(seller_months: DataFrame, key: str = "seller_id", value: str = "gmv") -> DataFrame:
    """(month, retained_gmv, previous_gmv) from one row per seller and month.

    Retained: this month's GMV of sellers active in the month before. Previous: all GMV of the
    month before. Only months with some retained seller appear.
    """
    totals = (
        with_previous_month(seller_months, key)
        .groupBy("month")
        .agg(
            retained_sum(F.col(value)).alias("retained_gmv"),
            F.max("retained").alias("any_retained"),
            F.sum(value).alias("month_gmv"),
        )
    )
    return (
        with_month_before(totals, "month_gmv", "previous_gmv")
        .where("any_retained")
        .select("month", "retained_gmv", "previous_gmv")
    )
