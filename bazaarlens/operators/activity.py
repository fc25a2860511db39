"""Who was active when: both roles of a sale in one scan, first activity, new against existing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions.dates import month_of


def both_roles(sales: DataFrame, *carried: str) -> DataFrame:
    """Two rows per sale, (store_id, bought, sold, carried columns), without a second scan."""
    leg = F.explode(
        F.array(
            F.struct(F.col("buyer_id").alias("store_id"), F.lit(True).alias("bought"), F.lit(False).alias("sold")),
            F.struct(F.col("seller_id").alias("store_id"), F.lit(False).alias("bought"), F.lit(True).alias("sold")),
        )
    ).alias("leg")
    return sales.select(leg, *carried).select("leg.store_id", "leg.bought", "leg.sold", *carried)


def first_activity(rows: DataFrame, key: str, time: str, name: str = "first") -> DataFrame:
    """Earliest time per key. Which rows count (statuses, range) is the caller's filter."""
    return rows.groupBy(key).agg(F.min(time).alias(name))


def store_months(sales: DataFrame, time: str = "seller_signed_on") -> DataFrame:
    """(store_id, month, bought, sold, first_month): one row per store and active month.

    The window runs over this reduced frame, so a store holds at most one row per month in it
    however many sales it has.
    """
    active = (
        both_roles(sales, time)
        .where(F.col("store_id").isNotNull() & F.col(time).isNotNull())
        .groupBy("store_id", month_of(F.col(time)).alias("month"))
        .agg(F.max("bought").alias("bought"), F.max("sold").alias("sold"))
    )
    return with_first_month(active, "store_id")


def with_first_month(monthly: DataFrame, key: str, month: str = "month") -> DataFrame:
    """Add first_month per key to a frame that has one row per key and month."""
    return monthly.withColumn("first_month", F.min(month).over(Window.partitionBy(key)))


def is_new(month: str = "month") -> Column:
    return F.col("first_month") == F.col(month)


def is_existing(month: str = "month") -> Column:
    return F.col("first_month") < F.col(month)


def split_new_existing(value: Column, key: str, month: str = "month") -> tuple[Column, Column]:
    """Sums of value over new and over existing keys; a NULL key is neither."""
    known = F.col(key).isNotNull()
    return F.sum(F.when(known & is_new(month), value)), F.sum(F.when(known & is_existing(month), value))
