"""Monthly buyer and seller key figures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions.dates import between, month_of
from bazaarlens.functions.formats import short_month
from bazaarlens.functions.ratios import filled, hundredth, ratio_or_null, rounded
from bazaarlens.operators.activity import is_new, split_new_existing, with_first_month
from bazaarlens.operators.savings import savings_lenient
from bazaarlens.operators.sell_through import booked_sales, included_items
from bazaarlens.sources.marketplace import Marketplace

SIGNED = "seller_signed_on"


def _range_sales(mk: Marketplace, start: dt.date, end: dt.date, *columns: str) -> DataFrame:
    """The different sale rows of the range, how often each is there (`rows`), and how many rows their invoice has
    (`copies`). The invoice's number is added up over its different rows, nearly always one, not over the sales."""
    sales = booked_sales(mk, "invoice_id", SIGNED, *columns, signed=(start, end))
    sales = sales.where(between(F.col(SIGNED), start, end) & F.col("invoice_id").isNotNull())
    row = sales.select("invoice_id", *columns, month_of(F.col(SIGNED)).alias("month"))
    rows = row.groupBy(*row.columns).agg(F.count(F.lit(1)).alias("rows"))
    return rows.withColumn("copies", F.sum("rows").over(Window.partitionBy("invoice_id")))


def _monthly(per_store: DataFrame, store: str, *sums: str) -> DataFrame:
    """Roll one row per store and month up to months; "new" means first seen in the range."""
    new_gmv, repeat_gmv = split_new_existing(F.col("gmv"), store)
    return with_first_month(per_store, store).groupBy("month").agg(
        *[F.sum(name).alias(name) for name in ("gmv", "transactions", *sums)],
        F.count(store).alias("active"),
        F.count_if(is_new()).alias("new"),
        new_gmv.alias("new_gmv"),
        repeat_gmv.alias("repeat_gmv"),
    )


def buyer_lines(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    """One row per different sale row with an included item, and how often it is there (`rows`): units and savings of
    its lines with a post. A repeated invoice has its lines once per row, and each row then counts all of them."""
    drugs = mk.table("drugs", "ndc_upc_hri", "package_price", "unit_price").withColumnRenamed("ndc_upc_hri", "ndc")
    posts = mk.table("posts", "post_id", "ndc", "price", "partial_quantity")
    saving = savings_lenient(F.col("partial_quantity"), F.col("unit_price"), F.col("package_price"), F.col("price"))
    priced = posts.join(drugs, "ndc", "left").select("post_id", F.lit(1).alias("matched"), saving.alias("saving"))
    row = ["invoice_id", "buyer_id", "month", "subtotal", "copies"]
    sales = _range_sales(mk, start, end, "buyer_id", "subtotal")
    weight = F.col("rows") * F.col("copies")
    return (
        sales.join(included_items(mk, "invoice_id", "post_id"), "invoice_id")
        .join(priced, "post_id", "left")
        .groupBy(*row, "rows")
        .agg(F.count("matched").alias("lines"), F.sum(F.when(F.col("matched") == 1, F.col("saving"))).alias("saving"))
        .select(
            "invoice_id", "buyer_id", "month", "rows", (F.col("subtotal") * F.col("rows")).alias("gmv"),
            (F.col("lines") * weight).alias("units"), (F.col("saving") * weight).alias("savings"),
        )
    )


def buyers_kpi(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    per_buyer = buyer_lines(mk, start, end).groupBy("buyer_id", "month").agg(
        F.sum("gmv").alias("gmv"),
        F.sum("rows").alias("transactions"),
        F.sum("units").alias("units"),
        F.sum("savings").alias("savings"),
    )
    rows = _monthly(per_buyer, "buyer_id", "units", "savings")
    return rows.orderBy("month").select(
        short_month(F.col("month")).alias("Month"),
        F.round(filled(F.col("gmv")), 2).alias("GMV ($)"),
        F.col("transactions").alias("Total Transactions"),
        F.col("units").alias("Units Bought"),
        F.col("active").alias("Active Buyers"),
        F.col("new").alias("New Buyers"),
        (F.col("active") - F.col("new")).alias("Repeat Buyers"),
        F.round(filled(F.col("new_gmv")), 2).alias("GMV from New ($)"),
        F.round(filled(F.col("repeat_gmv")), 2).alias("GMV from Repeat ($)"),
        rounded(ratio_or_null(F.col("gmv"), F.col("transactions")), 2).alias("Avg Order Value ($)"),
        F.round(filled(F.col("savings")), 2).alias("Total Savings ($)"),
    )


def sellers_kpi(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    """As for buyers, with net revenue; the seller counts are decimals."""
    sales = _range_sales(mk, start, end, "seller_id", "subtotal", "fee_percent")
    fee = F.coalesce(F.col("fee_percent"), F.lit(0).cast("decimal(1,0)"))
    # Items are counted behind the join: counted before it, a task would hold a group for nearly every item it scans.
    lines = included_items(mk, "invoice_id").join(sales, "invoice_id")
    per_seller = (
        lines.groupBy(*sales.columns)
        .agg(F.count(F.lit(1)).alias("items"))
        .groupBy("seller_id", "month")
        .agg(
            F.sum(F.col("subtotal") * F.col("rows")).alias("gmv"),
            F.sum("rows").alias("transactions"),
            F.sum(F.col("items") * F.col("copies") * F.col("rows")).alias("units"),
            F.sum(F.col("subtotal") * fee * F.col("rows")).alias("points"),
        )
    )
    rows = _monthly(per_seller, "seller_id", "units", "points")

    def count(value: Column) -> Column:
        return value.cast("decimal(20,2)")

    return rows.orderBy("month").select(
        short_month(F.col("month")).alias("Month"),
        F.round(filled(F.col("gmv")), 2).alias("GMV ($)"),
        F.col("transactions").alias("Total Transactions"),
        F.col("units").alias("Units Sold"),
        count(F.col("active")).alias("Active Sellers"),
        count(F.col("new")).alias("New Sellers"),
        count(F.col("active") - F.col("new")).alias("Repeat Sellers"),
        F.round(filled(F.col("new_gmv")), 2).alias("GMV from New ($)"),
        F.round(filled(F.col("repeat_gmv")), 2).alias("GMV from Repeat ($)"),
        rounded(ratio_or_null(F.col("gmv"), F.col("transactions")), 2).alias("Avg Order Value ($)"),
        F.round(filled(hundredth(F.col("points"))), 2).alias("Net Revenue ($)"),
    )
