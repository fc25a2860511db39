"""Activity of each store in a past and a current period, over both sale roles and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.operators.activity import both_roles
from bazaarlens.operators.periods import PeriodPair, label_periods


def churn_flags(sales: DataFrame, posts: DataFrame, pair: PeriodPair) -> DataFrame:
    """One row per store: past_purchase, past_sale, past_post (had any in the past period) and
    purchases, sales, posts: how many different ones in the current period.

    Rows of a store and item collapse before the shuffle, so counting items is counting rows.
    """
    trades = both_roles(sales, "invoice_id", "seller_signed_on").select(
        "store_id", "bought", "sold", F.lit(False).alias("posted"),
        F.col("invoice_id").alias("item"), *label_periods(pair, F.col("seller_signed_on")),
    )
    listings = posts.select(
        F.col("seller_id").alias("store_id"), F.lit(False).alias("bought"), F.lit(False).alias("sold"),
        F.lit(True).alias("posted"), F.col("post_id").alias("item"), *label_periods(pair, F.col("created_at")),
    )
    roles = {"purchase": "bought", "sale": "sold", "post": "posted"}
    known = F.col("item").isNotNull()
    items = (
        trades.unionByName(listings)
        .where(F.col("store_id").isNotNull() & (F.col("in_current") | F.col("in_previous")))
        .groupBy("store_id", "item")
        .agg(
            *[F.max(F.col(flag) & F.col("in_previous")).alias(f"past_{name}") for name, flag in roles.items()],
            *[F.max(F.col(flag) & F.col("in_current") & known).alias(f"now_{name}") for name, flag in roles.items()],
        )
    )
    return items.groupBy("store_id").agg(
        *[F.max(f"past_{name}").alias(f"past_{name}") for name in roles],
        *[F.count_if(f"now_{name}").alias(f"{name}s") for name in roles],
    )
