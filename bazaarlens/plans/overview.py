"""Headline numbers and the monthly goal."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.dates import as_of_today, date, first_of_month, local_date
from bazaarlens.functions.ratios import filled
from bazaarlens.operators.periods import calendar_month, month_and_previous
from bazaarlens.operators.sell_through import BOOKED
from bazaarlens.sources.marketplace import Marketplace


@as_of_today("America/Los_Angeles")
def admin_metrics(
    mk: Marketplace, as_of: dt.date, staff_domain: str = "@staff.example", borders: str = "UTC"
) -> DataFrame:
    """Seven unrelated numbers in one row, all by creation time.

    as_of is the local day of the reader (without one: today in `zone`), `borders` the zone whose months count; staff_domain
    ends the mail addresses left out.
    """
    pair = month_and_previous(as_of, borders)
    created = F.col("created_at")
    now, before = pair.current.holds(created), pair.previous.holds(created)
    booked = F.col("invoice_status").isin(*BOOKED)

    def total(condition: Column) -> Column:
        return filled(F.sum(F.when(condition, F.col("subtotal"))))

    money = (
        mk.table("sales", "subtotal", "invoice_status", "created_at")
        .where(pair.either(created))
        .agg(
            total(now & booked).alias("total_sales"),
            total(now & (F.col("invoice_status") == "NOT_STARTED")).alias("pending_sales"),
            total(before & booked).alias("prev_total_sales"),
        )
    )
    carts = mk.table("carts", "subtotal").agg(filled(F.sum("subtotal")).alias("pending_carts"))
    signed_in = calendar_month(as_of, zone=borders).holds(F.col("last_sign_in_at"))
    users = (
        mk.table("users", "id", "email", "last_sign_in_at")
        .where(signed_in & ~F.col("email").ilike(f"%{staff_domain}"))
        .agg(F.count_distinct("id").alias("active_users"))
    )
    completed = (
        mk.table("invoices", "invoice_id", "invoice_status", statuses=("COMPLETED",))
        .where(F.col("invoice_status") == "COMPLETED")
        .select("invoice_id")
    )
    items = (
        mk.table("invoice_items", "invoice_item_id", "invoice_id", "created_at")
        .where(pair.either(created))
        .join(completed, "invoice_id")
        .groupBy("invoice_item_id")
        .agg(F.max(now).alias("now"), F.max(before).alias("before"))
        .where("invoice_item_id IS NOT NULL")
        .agg(F.count_if("now").alias("posts_sold"), F.count_if("before").alias("prev_posts_sold"))
    )
    # Every side is one row.
    return money.crossJoin(carts).crossJoin(users).crossJoin(items).select(
        "total_sales", "pending_sales", "pending_carts", "active_users",
        "posts_sold", "prev_total_sales", "prev_posts_sold",
    )


def monthly_goal(mk: Marketplace, now: dt.datetime | None = None, zone: str = "America/Los_Angeles") -> DataFrame:
    """The goals entered for the month that `now` (by default this moment) falls in, in the given zone."""
    today = local_date(now or dt.datetime.now(dt.timezone.utc), zone)
    month = F.col("month_year")
    return mk.table("monthly_sales_goal", "month_year", "sales_goal").where(
        (month >= date(first_of_month(today))) & (month < date(first_of_month(today, 1)))
    ).select("sales_goal")
