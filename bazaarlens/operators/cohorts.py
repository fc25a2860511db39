"""What became of the stores that signed up in a month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.dates import month_of


def onboarded(stores: DataFrame, funding: DataFrame) -> DataFrame:
    """Store rows whose funding account was created, and started, in the signup month."""
    accounts = funding.where(F.col("funding_status") != "NOT_STARTED").select(
        "funding_id", month_of(F.col("created_at")).alias("funding_month")
    )
    return (
        stores.join(accounts, "funding_id")
        .where(F.col("funding_month") == month_of(F.col("created_at")))
        .drop("funding_month")
    )


def activated(stores: DataFrame, first_months: DataFrame) -> DataFrame:
    """Store rows whose first active month is the signup month; first_months has one row per store."""
    return (
        stores.join(first_months.select("store_id", "first_month"), "store_id")
        .where(F.col("first_month") == month_of(F.col("created_at")))
        .drop("first_month")
    )
