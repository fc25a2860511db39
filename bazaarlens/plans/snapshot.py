"""Month to date against the same stretch of last month."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.dates import as_of_today, border, first_of_month, timestamp
from bazaarlens.functions.ratios import average, growth, ratio_if_positive, ratio_or_zero, rounded
from bazaarlens.operators.activity import both_roles, first_activity
from bazaarlens.operators.compare import compare_periods, distinct_in_periods
from bazaarlens.operators.periods import calendar_month, mtd_full_day, mtd_to_midnight
from bazaarlens.operators.sell_through import (
    booked_sales,
    days_to_sale,
    included_items,
    included_per_invoice,
)
from bazaarlens.sources.marketplace import Marketplace
from bazaarlens.state.activity import ActivityState

SIGNED = "seller_signed_on"


@as_of_today()
def mtd_activation(
    mk: Marketplace, as_of: dt.date, state: ActivityState | None = None, borders: str = "UTC"
) -> DataFrame:
    """New stores of this month and those whose first booked sale, in either role, is in it."""
    month = calendar_month(as_of, zone=borders)
    start, end = month.span
    new = mk.table("stores", "store_id", "created_at").where(month.holds(F.col("created_at")))
    if state is not None:
        if borders != "UTC":
            raise ValueError("the state is kept by UTC months")
        firsts = state.active_months(as_of).groupBy("store_id").agg(F.min("month").alias("first"))
    else:
        # Sales after this month cannot make a store's first month this one.
        past = booked_sales(mk, "buyer_id", "seller_id", SIGNED, signed=(None, end))
        past = both_roles(past.where(F.col(SIGNED) < timestamp(end)), SIGNED).where("store_id IS NOT NULL")
        firsts = first_activity(past, "store_id", SIGNED)
    active = new.join(firsts.where(F.col("first") >= timestamp(start)), "store_id")
    counts = new.agg(F.count(F.lit(1)).alias("total_new_stores")).crossJoin(
        active.agg(F.count(F.lit(1)).alias("activated_stores"))
    )
    rate = ratio_or_zero(F.col("activated_stores"), F.col("total_new_stores"))
    return counts.select("*", rounded(rate, 4).alias("activation_rate"))


@as_of_today()
def mtd_active_posts(mk: Marketplace, as_of: dt.date, borders: str = "UTC") -> DataFrame:
    """Posts active now; "last month" means those of them not created this month."""
    created = F.col("created_at") >= timestamp(border(first_of_month(as_of), borders))
    counts = (
        mk.table("posts", "status", "created_at")
        .where(F.col("status") == "ACTIVE")
        .agg(F.count(F.lit(1)).alias("active_now"), F.count_if(created).alias("created"))
        .select("active_now", "created", (F.col("active_now") - F.col("created")).alias("active_last_month"))
    )
    change = ratio_if_positive(F.col("created"), F.col("active_last_month"))
    return counts.select(
        "active_now", "active_last_month", rounded(change, 4).alias("current_vs_last_month_pct")
    )


def _with_growth(pair: DataFrame, now: str, before: str, now_as: str, before_as: str) -> DataFrame:
    change = rounded(growth(F.col(now), F.col(before)), 4)
    return pair.select(
        F.col(now).alias(now_as), F.col(before).alias(before_as), change.alias("current_vs_last_month_pct")
    )


@as_of_today()
def mtd_active_stores(mk: Marketplace, as_of: dt.date, borders: str = "UTC") -> DataFrame:
    pair = mtd_to_midnight(as_of, borders)
    # both_roles sits above the time filter, so the filter reaches the scan.
    sales = booked_sales(mk, "buyer_id", "seller_id", SIGNED, signed=pair.span).where(pair.either(F.col(SIGNED)))
    counts = distinct_in_periods(both_roles(sales, SIGNED), "store_id", SIGNED, pair)
    return _with_growth(counts, "keys_now", "keys_before", "active_stores_now", "active_stores_last_month")


@as_of_today()
def mtd_total_invoices(mk: Marketplace, as_of: dt.date, borders: str = "UTC") -> DataFrame:
    """Booked invoices, pending ones included whatever the column is called."""
    pair = mtd_to_midnight(as_of, borders)
    sales = booked_sales(mk, "invoice_id", SIGNED, signed=pair.span)
    counts = distinct_in_periods(sales, "invoice_id", SIGNED, pair)
    return _with_growth(
        counts, "keys_now", "keys_before", "mtd_completed_invoices", "last_month_completed_invoices"
    )


@as_of_today()
def mtd_items_sold(mk: Marketplace, as_of: dt.date, borders: str = "UTC") -> DataFrame:
    pair = mtd_to_midnight(as_of, borders)
    sales = booked_sales(mk, "invoice_id", SIGNED, signed=pair.span).where(pair.either(F.col(SIGNED)))
    items = sales.join(included_per_invoice(mk), "invoice_id")
    counts = compare_periods(
        items, SIGNED, pair, {"items": lambda flag: F.coalesce(F.sum(F.when(flag, F.col("items"))), F.lit(0))}
    )
    return _with_growth(counts, "items_now", "items_before", "items_sold_now", "items_sold_last_month")


@as_of_today()
def mtd_aov(mk: Marketplace, as_of: dt.date, borders: str = "UTC") -> DataFrame:
    """Average order value; the growth compares the unrounded averages."""
    pair = mtd_full_day(as_of, borders)
    totals = compare_periods(
        booked_sales(mk, "invoice_id", "subtotal", SIGNED, signed=pair.span),
        SIGNED,
        pair,
        {
            "total": lambda flag: F.coalesce(F.sum(F.when(flag, F.col("subtotal"))), F.lit(0)),
            "invoices": lambda flag: F.count(F.when(flag, F.col("invoice_id"))),
        },
    )
    values = totals.select(
        ratio_or_zero(F.col("total_now"), F.col("invoices_now")).alias("now"),
        ratio_or_zero(F.col("total_before"), F.col("invoices_before")).alias("before"),
    )
    return values.select(
        rounded(F.col("now"), 2).alias("aov_current"),
        rounded(F.col("before"), 2).alias("aov_last_month"),
        rounded(growth(F.col("now"), F.col("before")), 4).alias("growth_pct"),
    )


@as_of_today()
def mtd_avg_days(mk: Marketplace, as_of: dt.date, borders: str = "UTC") -> DataFrame:
    """Days from listing to sale; the change compares the rounded averages."""
    pair = mtd_to_midnight(as_of, borders)
    sales = booked_sales(mk, "invoice_id", SIGNED, signed=pair.span).where(pair.either(F.col(SIGNED)))
    lines = (
        sales.join(included_items(mk, "invoice_id", "post_id"), "invoice_id")
        .join(mk.table("posts", "post_id", "created_at"), "post_id")
        .select(SIGNED, days_to_sale().alias("days"))
    )
    parts = compare_periods(
        lines,
        SIGNED,
        pair,
        {
            "days": lambda flag: F.sum(F.when(flag, F.col("days"))),
            "lines": lambda flag: F.count(F.when(flag, F.col("days"))),
        },
    )
    rounded_means = parts.select(
        rounded(average(F.col("days_now"), F.col("lines_now")), 2).alias("avg_days_to_sell_now"),
        rounded(average(F.col("days_before"), F.col("lines_before")), 2).alias("avg_days_to_sell_last_month"),
    )
    change = growth(F.col("avg_days_to_sell_now"), F.col("avg_days_to_sell_last_month"))
    return rounded_means.select("*", rounded(change, 4).alias("avg_days_to_sell_change_pct"))
