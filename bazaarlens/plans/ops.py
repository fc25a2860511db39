"""Monthly tables on a month calendar: marketplace, revenue, users and stores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.dates import first_of_month, in_months, month_of, timestamp
from bazaarlens.functions.formats import plain_money, year_month
from bazaarlens.functions.ratios import (
    average,
    hundredth,
    ratio_or_null,
    ratio_or_zero,
    rounded,
)
from bazaarlens.operators.activity import split_new_existing, store_months, with_first_month
from bazaarlens.operators.cohorts import onboarded
from bazaarlens.operators.retention import retained_sum, with_month_before, with_previous_month
from bazaarlens.operators.sell_through import booked_sales, days_to_sale, included_items
from bazaarlens.operators.spines import fill_spine, month_spine
from bazaarlens.sources.marketplace import Marketplace
from bazaarlens.state.activity import ActivityState, folded_sales, month_orders, seller_months

SIGNED = "seller_signed_on"


def marketplace_report(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    """New posts, items sold, days to sale and invoices per month.

    Only months of the calendar are kept, so every arm reads just their rows.
    """
    span = (first_of_month(start), first_of_month(end, 1))
    sales = booked_sales(mk, "invoice_id", SIGNED, signed=span).where(in_months(F.col(SIGNED), start, end))
    month = month_of(F.col(SIGNED)).alias("month")
    invoices = sales.groupBy(month).agg(F.count(F.lit(1)).alias("Invoice Count"))
    # Posts join from the outside: an item without its post is sold, but has no days.
    lines = (
        sales.join(included_items(mk, "invoice_id", "invoice_item_id", "post_id"), "invoice_id")
        .join(mk.table("posts", "post_id", "created_at"), "post_id", "left")
        .select(month, "invoice_item_id", days_to_sale().alias("days"))
    )
    sold = lines.groupBy("month").agg(
        F.count_distinct("invoice_item_id").alias("Items Sold"),
        rounded(average(F.sum("days"), F.count("days")), 2).alias("Avg Days to Sale"),
    )
    # The same columns as above, so that a derived relation is worked out once.
    posts = (
        mk.table("posts", "post_id", "created_at", created=span)
        .where(in_months(F.col("created_at"), start, end))
        .groupBy(month_of(F.col("created_at")).alias("month"))
        .agg(F.count(F.lit(1)).alias("New Posts"))
    )
    measures = ["New Posts", "Items Sold", "Avg Days to Sale", "Invoice Count"]
    filled = fill_spine(
        month_spine(mk.spark, start, end), "month", posts, sold, invoices, zero=dict.fromkeys(measures, 0)
    )
    return filled.orderBy("month").select(year_month(F.col("month")).alias("Month"), *measures)


def _history(mk: Marketplace, end: dt.date, state: ActivityState | None) -> tuple[DataFrame, DataFrame]:
    """Sellers by month and different invoices by month, kept or from the sales. First months and retention look back
    over all history, never past the last month shown."""
    if state is not None:
        return state.seller_months(end), state.month_orders(end)
    until = first_of_month(end, 1)
    sales = booked_sales(
        mk, "invoice_id", "seller_id", "fee_percent", "subtotal", SIGNED, signed=(None, until)
    ).where(F.col(SIGNED) < timestamp(until))
    return seller_months(folded_sales(sales)), month_orders(folded_sales(sales))


def revenue_report(mk: Marketplace, start: dt.date, end: dt.date, state: ActivityState | None = None) -> DataFrame:
    """GMV, revenue, take rate, new and existing sellers, retention and order value per month.

    A fee that is not known adds to GMV but not to revenue. Money comes out as text. The windows
    see one row per seller and month; with a kept state no sale is read.
    """
    sellers, orders = _history(mk, end, state)
    new_points, existing_points = split_new_existing(F.col("points"), "seller_id")
    months = (
        with_first_month(with_previous_month(sellers, "seller_id"), "seller_id")
        .groupBy("month")
        .agg(
            F.sum("gmv").alias("month_gmv"),
            F.sum("points").alias("points"),
            F.sum("rows").alias("total_invoices"),
            new_points.alias("new_points"),
            existing_points.alias("existing_points"),
            retained_sum(F.col("gmv")).alias("retained_gmv"),
        )
    )
    spine = month_spine(mk.spark, start, end)
    rows = fill_spine(spine, "month", with_month_before(months, "month_gmv", "previous_gmv"), orders)

    def money(value: Column) -> Column:
        return plain_money(F.coalesce(value, F.lit(0)))

    revenue = hundredth(F.col("points"))
    take_rate = rounded(F.lit(100.0) * ratio_or_zero(revenue, F.col("month_gmv")), 2)
    retention_pct = rounded(F.lit(100.0) * ratio_or_zero(F.col("retained_gmv"), F.col("previous_gmv")), 2)
    order_value = rounded(ratio_or_null(F.col("month_gmv"), F.col("orders")), 2)
    return rows.orderBy("month").select(
        year_month(F.col("month")).alias("Month"),
        money(F.col("month_gmv")).alias("GMV ($)"),
        money(revenue).alias("Net Revenue ($)"),
        money(take_rate).alias("Weighted Take Rate (%)"),
        money(hundredth(F.col("new_points"))).alias("Revenue from New Sellers ($)"),
        money(hundredth(F.col("existing_points"))).alias("Revenue from Existing Sellers ($)"),
        money(retention_pct).alias("GMV Retention (%)"),
        money(order_value).alias("Avg Order Value ($)"),
        F.coalesce("total_invoices", F.lit(0)).alias("Total Invoices"),
    )


def user_store_report(mk: Marketplace, start: dt.date, end: dt.date, state: ActivityState | None = None) -> DataFrame:
    """Signups, onboardings, first customers, activations and active stores per month."""
    if state is not None:
        active = with_first_month(state.active_months(end), "store_id")
    else:
        until = first_of_month(end, 1)
        sales = booked_sales(mk, "buyer_id", "seller_id", SIGNED, signed=(None, until))
        active = store_months(sales.where(F.col(SIGNED) < timestamp(until)))
    signups = mk.table("stores", "store_id", "funding_id", "created_at").where(
        in_months(F.col("created_at"), start, end)
    )
    cohort = signups.select("store_id", month_of(F.col("created_at")).alias("signup_month"))
    # One row per store and month meets one row per store: activation costs no second pass.
    new = F.col("month") == F.col("first_month")
    activity = (
        active.join(cohort, "store_id", "left")
        .groupBy("month")
        .agg(
            F.count_if(new).alias("New Customers"),
            F.count_if(new & (F.col("month") == F.col("signup_month"))).alias("Activations"),
            F.count("store_id").alias("Active Stores"),
            F.count_if("bought").alias("Active Buyers"),
            F.count_if("sold").alias("Active Sellers"),
        )
    )
    month = month_of(F.col("created_at")).alias("month")
    joined = signups.groupBy(month).agg(F.count(F.lit(1)).alias("New Sign-ups"))
    funding = mk.table("funding_accounts", "funding_id", "funding_status", "created_at")
    started = onboarded(signups, funding).groupBy(month).agg(F.count(F.lit(1)).alias("New Onboards"))
    counts = [
        "New Sign-ups", "New Onboards", "New Customers", "Activations",
        "Active Stores", "Active Buyers", "Active Sellers",
    ]
    rows = fill_spine(
        month_spine(mk.spark, start, end), "month", activity, joined, started, zero=dict.fromkeys(counts, 0)
    )

    def percent(part: str) -> Column:
        return rounded(F.lit(100.0) * ratio_or_zero(F.col(part), F.col("New Sign-ups")), 2)

    return rows.orderBy("month").select(
        year_month(F.col("month")).alias("Month"),
        "New Sign-ups",
        "New Onboards",
        percent("New Onboards").alias("New Onboards Percent"),
        "New Customers",
        "Activations",
        percent("Activations").alias("Activations Percent"),
        "Active Stores",
        "Active Buyers",
        "Active Sellers",
    )
