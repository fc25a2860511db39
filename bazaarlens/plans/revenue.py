"""Month-to-date money: GMV, platform revenue, take rate, mix and retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.dates import as_of_today, date, first_of_month, timestamp
from bazaarlens.functions.formats import padded_month_name
from bazaarlens.functions.ratios import (
    filled,
    hundredth,
    percent_or_null,
    ratio_or_null,
    ratio_or_zero,
    rounded,
)
from bazaarlens.operators.activity import first_activity
from bazaarlens.operators.periods import Period, month_and_previous, mtd_full_day
from bazaarlens.operators.sell_through import booked_sales, completed_sales, included_per_invoice
from bazaarlens.operators.shares import with_total
from bazaarlens.sources.marketplace import Marketplace
from bazaarlens.state.activity import ActivityState

SIGNED = "seller_signed_on"


def _month_name(as_of: dt.date) -> Column:
    return padded_month_name(date(first_of_month(as_of))).alias("month_name")


def _of_status(mk: Marketplace, status: str, month: Period, *columns: str) -> DataFrame:
    rows = mk.table("sales", "invoice_status", SIGNED, *columns, statuses=(status,), signed=month.span)
    return rows.where((F.col("invoice_status") == status) & month.holds(F.col(SIGNED)))


def money_or_zero(name: str) -> Column:
    # A one-digit zero keeps the column's own precision.
    return F.coalesce(F.col(name), F.lit(0).cast("decimal(1,0)"))


def fee_points(weight: Column | None = None) -> Column:
    """Fee percent x money, a hundred times the platform's share; exact in DECIMAL."""
    points = money_or_zero("fee_percent") * money_or_zero("subtotal")
    return points if weight is None else points * weight


def _gmv(mk: Marketplace, status: str, as_of: dt.date, name: str, borders: str) -> DataFrame:
    total = F.round(F.sum(money_or_zero("subtotal")), 2).cast("double").alias(name)
    month = mtd_full_day(as_of, borders).current
    return _of_status(mk, status, month, "subtotal").agg(total).select(_month_name(as_of), name)


def _revenue(mk: Marketplace, status: str, as_of: dt.date, name: str, borders: str) -> DataFrame:
    total = F.round(hundredth(F.sum(fee_points())), 2).cast("double").alias(name)
    month = mtd_full_day(as_of, borders).current
    return _of_status(mk, status, month, "subtotal", "fee_percent").agg(total).select(_month_name(as_of), name)


@as_of_today()
def completed_gmv(mk: Marketplace, as_of: dt.date, borders: str = "UTC") -> DataFrame:
    return _gmv(mk, "COMPLETED", as_of, "gmv_mtd", borders)


@as_of_today()
def completed_revenue(mk: Marketplace, as_of: dt.date, borders: str = "UTC") -> DataFrame:
    return _revenue(mk, "COMPLETED", as_of, "total_platform_revenue_mtd", borders)


@as_of_today()
def pending_gmv(mk: Marketplace, as_of: dt.date, borders: str = "UTC") -> DataFrame:
    return _gmv(mk, "PENDING", as_of, "total_pending_amount", borders)


@as_of_today()
def pending_revenue(mk: Marketplace, as_of: dt.date, borders: str = "UTC") -> DataFrame:
    return _revenue(mk, "PENDING", as_of, "total_platform_revenue_pending", borders)


@as_of_today()
def weighted_take_rate(mk: Marketplace, as_of: dt.date, borders: str = "UTC") -> DataFrame:
    """Revenue over GMV, each invoice weighted by its number of included items."""
    month = mtd_full_day(as_of, borders).current
    sales = booked_sales(mk, "invoice_id", "subtotal", "fee_percent", SIGNED, signed=month.span)
    sales = sales.where(month.holds(F.col(SIGNED)))
    items = F.col("items")
    totals = sales.join(included_per_invoice(mk), "invoice_id").agg(
        hundredth(F.sum(fee_points(items))).alias("revenue"),
        F.sum(money_or_zero("subtotal") * items).alias("gmv"),
    )
    rate = rounded(ratio_or_null(F.col("revenue"), F.col("gmv")), 4).cast("double")
    return totals.select(_month_name(as_of), rate.alias("weighted_take_rate_mtd"))


@as_of_today()
def revenue_mix(
    mk: Marketplace, as_of: dt.date, state: ActivityState | None = None, borders: str = "UTC"
) -> DataFrame:
    """Revenue of sellers whose first completed sale is this month, and of all others.

    One row of totals is turned into the two output rows, so both are always there.
    """
    window = mtd_full_day(as_of, borders).current
    start, end = window.span
    sold = completed_sales(mk, "invoice_id", "seller_id", "subtotal", "fee_percent", SIGNED, signed=window.span)
    earned = (
        sold.where(window.holds(F.col(SIGNED)))
        .join(included_per_invoice(mk), "invoice_id")
        .groupBy("seller_id")
        .agg(F.sum(fee_points(F.col("items"))).alias("points"))
    )
    # Sales after the period cannot be the first sale of a seller that sold in it.
    if state is not None:
        if borders != "UTC":
            raise ValueError("the state is kept by UTC months")
        firsts = state.first_completed_sales(end)
    else:
        history = completed_sales(mk, "seller_id", SIGNED, signed=(None, end))
        history = history.where((F.col(SIGNED) < timestamp(end)) & F.col("seller_id").isNotNull())
        firsts = first_activity(history, "seller_id", SIGNED)
    new = F.coalesce(F.col("first") >= timestamp(start), F.lit(False))
    totals = earned.join(firsts, "seller_id", "left").agg(
        filled(hundredth(F.sum(F.when(~new, F.col("points"))))).alias("existing"),
        filled(hundredth(F.sum(F.when(new, F.col("points"))))).alias("new"),
    )
    types = F.array(
        F.struct(F.lit("Existing").alias("seller_type"), F.col("existing").alias("revenue")),
        F.struct(F.lit("New").alias("seller_type"), F.col("new").alias("revenue")),
    )
    rows = with_total(totals.select(F.explode(types).alias("t")).select("t.*"), "revenue")
    revenue = F.col("revenue")
    return rows.select(
        _month_name(as_of),
        "seller_type",
        F.round(revenue, 2).cast("double").alias("revenue_mtd"),
        rounded(percent_or_null(revenue, F.col("total")), 2).cast("double").alias("pct_of_total"),
    ).orderBy(F.desc_nulls_first("revenue_mtd"))


@as_of_today()
def gmv_retention_mtd(mk: Marketplace, as_of: dt.date, borders: str = "UTC") -> DataFrame:
    """GMV this month of sellers that also sold last month, over all of last month's GMV.

    Completed sales only, each counted once per included item; a fraction, NULL without data.
    """
    pair = month_and_previous(as_of, borders)
    signed = F.col(SIGNED)
    sales = completed_sales(mk, "invoice_id", "seller_id", "subtotal", SIGNED, signed=pair.span).where(pair.either(signed))
    value = money_or_zero("subtotal") * F.col("items")
    sellers = (
        sales.join(included_per_invoice(mk), "invoice_id")
        .groupBy("seller_id")
        .agg(
            F.sum(F.when(pair.current.holds(signed), value)).alias("now"),
            F.sum(F.when(pair.previous.holds(signed), value)).alias("before"),
        )
    )
    retained = F.col("seller_id").isNotNull() & F.col("before").isNotNull()
    totals = sellers.agg(
        F.sum(F.when(retained, F.col("now"))).alias("kept"), F.sum("before").alias("before")
    )
    rate = rounded(ratio_or_zero(F.col("kept"), F.col("before")), 4)
    return totals.select(rate.alias("gmv_retention_pct_current_month"))
