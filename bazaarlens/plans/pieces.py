"""Single operators run over the whole tables, as they appear inside the reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.dates import between, month_of, span_months
from bazaarlens.functions.formats import short_month
from bazaarlens.functions.ratios import (
    average,
    hundredth,
    ratio_or_null,
    ratio_or_zero,
    rounded,
)
from bazaarlens.operators.activity import (
    both_roles,
    first_activity,
    split_new_existing,
    store_months,
    with_first_month,
)
from bazaarlens.operators.cohorts import activated, onboarded
from bazaarlens.operators.compare import compare_periods, distinct_in_periods
from bazaarlens.operators.periods import (
    PeriodPair,
    month_and_previous,
    mtd_full_day,
    mtd_to_midnight,
    trailing_pair,
)
from bazaarlens.operators.retention import gmv_retention
from bazaarlens.operators.positions import with_position
from bazaarlens.operators.savings import savings_lenient, savings_strict
from bazaarlens.operators.sell_through import (
    LISTED,
    booked_sales,
    completed_sales,
    days_to_sale,
    listed_posts,
    regroup,
    sell_through,
    sold_items,
    store_states,
)
from bazaarlens.operators.spines import fill_spine, month_spine, months_covering
from bazaarlens.plans.investor import all_sheets, store_month_fact
from bazaarlens.plans.revenue import fee_points
from bazaarlens.sinks.workbook import kpi_sheets, report_name_column
from bazaarlens.operators.shares import with_total
from bazaarlens.sources.contract import Rules, violations
from bazaarlens.sources.marketplace import Marketplace

SIGNED = "seller_signed_on"


def period_totals(sales: DataFrame, pair: PeriodPair) -> DataFrame:
    """Number and money of the sales in both periods."""
    return compare_periods(
        sales,
        SIGNED,
        pair,
        {
            "sales": F.count_if,
            "gmv": lambda flag: F.sum(F.when(flag, F.col("subtotal"))),
        },
    )


def mtd_to_midnight_totals(mk: Marketplace, as_of: dt.date) -> DataFrame:
    pair = mtd_to_midnight(as_of)
    return period_totals(booked_sales(mk, SIGNED, "subtotal", signed=pair.span), pair)


def mtd_full_day_totals(mk: Marketplace, as_of: dt.date) -> DataFrame:
    pair = mtd_full_day(as_of)
    return period_totals(booked_sales(mk, SIGNED, "subtotal", signed=pair.span), pair)


def calendar_month_totals(mk: Marketplace, as_of: dt.date) -> DataFrame:
    pair = month_and_previous(as_of)
    return period_totals(booked_sales(mk, SIGNED, "subtotal", signed=pair.span), pair)


def trailing_totals(mk: Marketplace, as_of: dt.date, days: int) -> DataFrame:
    pair = trailing_pair(as_of, days)
    return period_totals(completed_sales(mk, SIGNED, "subtotal", signed=pair.span), pair)


def active_stores_full_day(mk: Marketplace, as_of: dt.date) -> DataFrame:
    pair = mtd_full_day(as_of)
    sales = booked_sales(mk, "buyer_id", "seller_id", SIGNED, signed=pair.span).where(pair.either(F.col(SIGNED)))
    return distinct_in_periods(both_roles(sales, SIGNED), "store_id", SIGNED, pair)


def store_activity(mk: Marketplace) -> DataFrame:
    active = store_months(booked_sales(mk, "buyer_id", "seller_id", SIGNED))
    return active.select("store_id", "month", "bought", "sold")


def seller_first_sale(mk: Marketplace) -> DataFrame:
    return first_activity(booked_sales(mk, "seller_id", SIGNED), "seller_id", SIGNED)


def buyer_first_in_range(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    sales = booked_sales(mk, "buyer_id", SIGNED).where(between(F.col(SIGNED), start, end))
    return first_activity(sales, "buyer_id", SIGNED)


def _seller_months(mk: Marketplace, *columns: str) -> DataFrame:
    sales = booked_sales(mk, "invoice_id", "seller_id", "subtotal", SIGNED, *columns)
    return sales.groupBy("seller_id", month_of(F.col(SIGNED)).alias("month")).agg(F.sum("subtotal").alias("gmv"))


def new_and_existing_gmv(mk: Marketplace) -> DataFrame:
    new, existing = split_new_existing(F.col("gmv"), "seller_id")
    return (
        with_first_month(_seller_months(mk), "seller_id")
        .groupBy("month")
        .agg(F.coalesce(new, F.lit(0)).alias("new_gmv"), F.coalesce(existing, F.lit(0)).alias("existing_gmv"))
    )


def monthly_retention(mk: Marketplace) -> DataFrame:
    rate = rounded(ratio_or_zero(F.col("retained_gmv"), F.col("previous_gmv")), 4)
    return gmv_retention(_seller_months(mk)).select(
        "month", "retained_gmv", "previous_gmv", rate.alias("retention")
    )


def cohort_activation(mk: Marketplace) -> DataFrame:
    legs = both_roles(booked_sales(mk, "buyer_id", "seller_id", SIGNED), SIGNED)
    firsts = first_activity(legs, "store_id", SIGNED).select("store_id", month_of(F.col("first")).alias("first_month"))
    stores = activated(mk.table("stores", "store_id", "created_at"), firsts)
    return stores.groupBy(month_of(F.col("created_at")).alias("month")).agg(F.count(F.lit(1)).alias("activations"))


def onboarding(mk: Marketplace) -> DataFrame:
    stores = onboarded(
        mk.table("stores", "store_id", "funding_id", "created_at"),
        mk.table("funding_accounts", "funding_id", "funding_status", "created_at"),
    )
    return stores.groupBy(month_of(F.col("created_at")).alias("month")).agg(F.count(F.lit(1)).alias("onboards"))


def sold_per_post(mk: Marketplace) -> DataFrame:
    return sold_items(mk, "subtotal").groupBy("post_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum("subtotal").alias("gmv")
    )


def seller_sell_through(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    sold = sold_items(mk, "buyer_id", SIGNED, "subtotal")
    by_buyer = sell_through(listed_posts(mk, start, end, "seller_id"), sold, ["seller_id"], ["buyer_id"])
    by_buyer = by_buyer.join(store_states(mk, "buyer_id", "buyer_state"), "buyer_id", "left")
    found = regroup(by_buyer, ["seller_id", "buyer_state"])
    return found.select("seller_id", "buyer_state", "made", "sold", "days", "subtotal")


def _line_prices(mk: Marketplace) -> DataFrame:
    drugs = mk.table("drugs", "ndc_upc_hri", "package_price", "unit_price").withColumnRenamed("ndc_upc_hri", "ndc")
    posts = mk.table("posts", "post_id", "ndc", "price", "partial_quantity")
    # Prices join the posts, and items then join once.
    return sold_items(mk).join(posts.join(drugs, "ndc"), "post_id")


def _savings(lines: DataFrame, saving: Column) -> DataFrame:
    return lines.groupBy("ndc").agg(F.count(saving).alias("lines"), F.sum(saving).alias("savings"))


def strict_savings(mk: Marketplace) -> DataFrame:
    prices = (F.col("partial_quantity"), F.col("unit_price"), F.col("package_price"), F.col("price"))
    return _savings(_line_prices(mk).where("price IS NOT NULL"), savings_strict(*prices))


def lenient_savings(mk: Marketplace) -> DataFrame:
    prices = (F.col("partial_quantity"), F.col("unit_price"), F.col("package_price"), F.col("price"))
    return _savings(_line_prices(mk), savings_lenient(*prices))


def monthly_take_rate(mk: Marketplace) -> DataFrame:
    sales = booked_sales(mk, "subtotal", "fee_percent", SIGNED)
    rate = ratio_or_null(hundredth(F.sum(fee_points())), F.sum("subtotal"))
    return sales.groupBy(month_of(F.col(SIGNED)).alias("month")).agg(rounded(rate, 4).alias("take_rate"))


def monthly_order_value(mk: Marketplace) -> DataFrame:
    sales = booked_sales(mk, "invoice_id", "subtotal", SIGNED)
    value = ratio_or_null(F.sum("subtotal"), F.count_distinct("invoice_id"))
    return sales.groupBy(month_of(F.col(SIGNED)).alias("month")).agg(rounded(value, 2).alias("order_value"))


def product_days_to_sale(mk: Marketplace) -> DataFrame:
    lines = sold_items(mk, SIGNED).join(mk.table("posts", "post_id", "ndc", "created_at"), "post_id")
    parts = lines.select("ndc", days_to_sale().alias("days")).groupBy("ndc")
    return parts.agg(rounded(average(F.sum("days"), F.count("days")), 2).alias("avg_days"))


def buyer_monthly_rate(mk: Marketplace) -> DataFrame:
    spent = booked_sales(mk, "buyer_id", "subtotal", SIGNED).groupBy("buyer_id")
    rate = ratio_or_null(F.sum("subtotal"), span_months(F.min(SIGNED), F.max(SIGNED)))
    return spent.agg(rounded(rate, 2).alias("per_month"))


def posts_by_month(mk: Marketplace) -> DataFrame:
    """The calendar is taken from the posts themselves."""
    posts = mk.table("posts", "created_at")
    counts = posts.groupBy(month_of(F.col("created_at")).alias("month")).agg(F.count(F.lit(1)).alias("posts"))
    return fill_spine(months_covering(posts, "created_at"), "month", counts, zero={"posts": 0})


def completed_by_month(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    sales = completed_sales(mk, SIGNED)
    counts = sales.groupBy(month_of(F.col(SIGNED)).alias("month")).agg(F.count(F.lit(1)).alias("sales"))
    return fill_spine(month_spine(mk.spark, start, end), "month", counts, zero={"sales": 0})


def labelled_spend(
    mk: Marketplace, start: dt.date, end: dt.date, label_start: dt.date, label_end: dt.date
) -> DataFrame:
    """Spend per month label; months the calendar does not label leave the sums."""
    spine = month_spine(mk.spark, label_start, label_end, "sale_month")
    labels = spine.select("sale_month", short_month(F.col("sale_month")).alias("label"))
    spend = store_month_fact(mk, "buyer_spend", start, end)
    return spend.join(F.broadcast(labels), "sale_month").groupBy("label").agg(F.sum("value").alias("value"))


def report_set(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    """The investor sheets in order, with their number of stores and their grand total."""
    return all_sheets(mk, start, end).groupBy("position", "sheet").agg(
        F.count("Store ID").alias("stores"), F.sum("Total").alias("total")
    )


def kpi_pair(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    """The two key figure sheets in order, in one frame; columns of the other sheet are NULL."""
    sheets = [
        frame.select(F.lit(i).alias("position"), F.lit(name).alias("sheet"), "*")
        for i, (name, frame) in enumerate(kpi_sheets(mk, start, end).items(), start=1)
    ]
    return sheets[0].unionByName(sheets[1], allowMissingColumns=True)


def report_name_of_sales(mk: Marketplace) -> DataFrame:
    span = booked_sales(mk, SIGNED).agg(F.min(SIGNED).alias("first"), F.max(SIGNED).alias("last"))
    return span.select(report_name_column("Stores_KPI_Monthly", F.col("first"), F.col("last")).alias("report"))


#: A stricter contract than the reports need: signed and priced rows, published posts, one post per seller, buyers that sell.
STRICT_CONTRACT = {
    "sales": Rules(
        "invoice_id", {"buyer_id": "posts.seller_id", "seller_id": "stores.store_id"}, ("seller_signed_on", "fee_percent"),
        {"invoice_status": ("COMPLETED", "PENDING")}, {"fee_percent": (0, 7)},
    ),
    "posts": Rules("seller_id", {"ndc": "drugs.ndc_upc_hri"}, ("price",), {"status": LISTED}),
    "stores": Rules("store_id", {"address_id": "addresses.address_id"}),
    "addresses": Rules("address_id"),
    "drugs": Rules("ndc_upc_hri"),
}


def contract_violations(mk: Marketplace) -> DataFrame:
    """What of the sales, posts and stores breaks the stricter contract."""
    return violations(mk, STRICT_CONTRACT, ids="string").drop("detail")


def shares_of_month(mk: Marketplace) -> DataFrame:
    """Each seller's share of a month's booked GMV, in percent."""
    rows = (
        booked_sales(mk, "seller_id", "subtotal", "seller_signed_on")
        .groupBy("seller_id", month_of(F.col("seller_signed_on")).alias("month"))
        .agg(F.sum("subtotal").alias("gmv"))
    )
    share = rounded(F.lit(100.0) * ratio_or_null(F.col("gmv"), F.col("total")), 4)
    return with_total(rows, "gmv", ["month"]).select("seller_id", "month", "gmv", "total", share.alias("share_pct"))


def ranked_sellers(mk: Marketplace) -> DataFrame:
    """Sellers by booked GMV, with their place overall."""
    rows = booked_sales(mk, "seller_id", "subtotal").groupBy("seller_id").agg(F.sum("subtotal").alias("gmv"))
    return with_position(rows, [F.desc_nulls_last("gmv"), F.asc("seller_id")])
