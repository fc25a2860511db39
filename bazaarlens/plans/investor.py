"""Store x month facts for investors, and their pivots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.dates import between, month_of
from bazaarlens.functions.formats import short_month
from bazaarlens.operators.activity import both_roles
from bazaarlens.operators.pivot import pivot_months
from bazaarlens.operators.sell_through import booked_sales, with_included_items
from bazaarlens.operators.spines import month_spine, months_covering
from bazaarlens.sources.marketplace import Marketplace
from bazaarlens.sources.schema import MONEY

SIGNED = "seller_signed_on"

# fixed values: fact name -> (sheet, role column, measure)
FACTS = {
    "rev_by_buyer": ("Platform Rev by Buyer", "buyer_id", "revenue"),
    "rev_by_seller": ("Platform Rev by Seller", "seller_id", "revenue"),
    "buyer_spend": ("Buyer Spend", "buyer_id", "spend"),
    "seller_earnings": ("Seller Earnings", "seller_id", "spend"),
    "buyer_txn": ("Buyer Transactions", "buyer_id", "count"),
    "seller_txn": ("Seller Transactions", "seller_id", "count"),
}


def months(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    """The month calendar with its labels."""
    return _labelled(month_spine(mk.spark, start, end, "sale_month"))


def months_of_sales(mk: Marketplace) -> DataFrame:
    """The same calendar over the span of booked sales, for a report on all of them."""
    return _labelled(months_covering(booked_sales(mk, SIGNED), SIGNED, "sale_month"))


def _labelled(spine: DataFrame) -> DataFrame:
    return spine.select("sale_month", short_month(F.col("sale_month")).alias("pretty")).orderBy("sale_month")


def _measure(name: str) -> Column:
    if name == "count":
        return F.count(F.lit(1))
    if name == "spend":
        return F.sum("subtotal")
    # Each invoice's share is rounded before the sum.
    fee = F.coalesce(F.col("fee_percent"), F.lit(0).cast("decimal(1,0)"))
    return F.sum(F.round(F.col("subtotal") * fee * F.lit("0.01").cast("decimal(2,2)"), 2))


def store_month_fact(mk: Marketplace, fact: str, start: dt.date, end: dt.date) -> DataFrame:
    """(store_id, sale_month, value) of booked sales signed in the range with an included item."""
    _, role, measure = FACTS[fact]
    sales = booked_sales(mk, "invoice_id", role, "subtotal", "fee_percent", SIGNED, signed=(start, end)).where(
        between(F.col(SIGNED), start, end)
    )
    return (
        with_included_items(sales, mk)
        .groupBy(F.col(role).alias("store_id"), month_of(F.col(SIGNED)).alias("sale_month"))
        .agg(_measure(measure).cast(MONEY).alias("value"))
        .orderBy(F.asc_nulls_last("store_id"), F.asc_nulls_last("sale_month"))
    )


def store_month_pivot(mk: Marketplace, fact: str, start: dt.date, end: dt.date) -> DataFrame:
    return pivot_months(store_month_fact(mk, fact, start, end), start, end)


def all_facts(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    """(position, sheet, store_id, sale_month, value): all six facts from one pass over the sales."""
    sales = booked_sales(
        mk, "invoice_id", "buyer_id", "seller_id", "subtotal", "fee_percent", SIGNED, signed=(start, end)
    ).where(between(F.col(SIGNED), start, end))
    legs = both_roles(with_included_items(sales, mk), "subtotal", "fee_percent", SIGNED)
    per_store = legs.groupBy("store_id", month_of(F.col(SIGNED)).alias("sale_month"), "bought").agg(
        *[_measure(m).cast(MONEY).alias(m) for m in ("revenue", "spend", "count")]
    )
    sheets = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(sheet).alias("sheet"),
            F.col(measure).alias("value"),
            (F.col("bought") == F.lit(role == "buyer_id")).alias("ours"),
        )
        for position, (sheet, role, measure) in enumerate(FACTS.values(), start=1)
    ]
    rows = per_store.select("store_id", "sale_month", F.explode(F.array(*sheets)).alias("f"))
    return rows.where("f.ours").select("f.position", "f.sheet", "store_id", "sale_month", "f.value")


def all_sheets(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    """The six pivots in one frame, told apart by position and sheet."""
    return pivot_months(all_facts(mk, start, end), start, end, "position", "sheet")
