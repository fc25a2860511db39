"""Churn and one-timer rates over two trailing periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.dates import as_of_today
from bazaarlens.functions.ratios import percent_or_null, rounded
from bazaarlens.operators.churn import churn_flags
from bazaarlens.operators.periods import trailing_pair
from bazaarlens.operators.sell_through import completed_sales
from bazaarlens.sources.marketplace import Marketplace


def store_churn_flags(mk: Marketplace, as_of: dt.date, window_days: int, borders: str = "UTC") -> DataFrame:
    pair = trailing_pair(as_of, window_days, borders)
    sales = completed_sales(
        mk, "invoice_id", "buyer_id", "seller_id", "seller_signed_on", signed=pair.span
    ).where(pair.either(F.col("seller_signed_on")))
    posts = mk.table("posts", "post_id", "seller_id", "created_at", created=pair.span).where(pair.either(F.col("created_at")))
    return churn_flags(sales, posts, pair)


@as_of_today()
def churn_rates(mk: Marketplace, as_of: dt.date, window_days: int, borders: str = "UTC") -> DataFrame:
    """Six percentages in one row. A store without any activity is in no base, so an inner join
    with the store list is enough."""
    flags = mk.table("stores", "store_id").join(store_churn_flags(mk, as_of, window_days, borders), "store_id")
    bought, sold, posted = F.col("past_purchase"), F.col("past_sale"), F.col("past_post")
    purchases, sales, posts = F.col("purchases"), F.col("sales"), F.col("posts")
    anything, seller_side = bought | sold | posted, sold | posted
    rates = {
        "Seller Churn (%)": (sold, (sales == 0) & (posts == 0)),
        "Buyer Churn (%)": (bought, purchases == 0),
        "Overall Churn (%)": (anything, (purchases == 0) & (sales == 0) & (posts == 0)),
        "One-timer (%)": (anything, purchases + sales == 1),
        "One-time Buyer (%)": (bought, purchases == 1),
        "One-time Seller (%)": (seller_side, sales == 1),
    }

    def share(base: Column, hit: Column) -> Column:
        return rounded(percent_or_null(F.count_if(base & hit), F.count_if(base)), 2)

    return flags.agg(*[share(base, hit).alias(name) for name, (base, hit) in rates.items()])
