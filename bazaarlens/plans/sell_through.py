"""Sell-through rate by product, state, store and market.

Every sort ends in the key of the rows, so that equal rates do not all land in one sort range.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.dates import between, span_months
from bazaarlens.functions.ratios import (
    average,
    percent_or_null,
    ratio_or_null,
    rounded,
)
from bazaarlens.operators.savings import savings_strict
from bazaarlens.operators.sell_through import (
    PARTS,
    booked_sales,
    included_items,
    listed_posts,
    numbered,
    regroup,
    sell_through,
    sell_through_rates,
    sold_items,
    store_states,
    times,
    weighted_drugs,
    weighted_states,
    with_all_of,
    with_matches,
)
from bazaarlens.sources.marketplace import Marketplace

SIGNED = "seller_signed_on"


def benchmark_markets(
    mk: Marketplace, start: dt.date, end: dt.date, min_posts: int = 100, min_rate: float = 0.5
) -> DataFrame:
    """State and product markets that sell well. Total Posts counts a listing once per sale."""
    market = ["seller_state", "drug_group", "ndc"]
    listed = listed_posts(mk, start, end, "ndc", "seller_id").drop("created_at")
    states = weighted_states(mk, "seller_id", "seller_state")
    groups = weighted_drugs(mk, "drug_group").withColumnRenamed("copies", "drug_copies")

    def in_market(rows: DataFrame) -> DataFrame:
        """The rows in each market, and how often the joins would give them (`copies`)."""
        joined = rows.join(states, "seller_id").join(groups, "ndc")
        return joined.withColumn("copies", F.col("copies") * F.col("drug_copies")).drop("drug_copies")

    # Lines are counted per listing and buyer before any attribute joins; then listings and buyers are rows.
    lines = numbered(listed).join(sold_items(mk, "buyer_id"), "post_id")
    owner = ["seller_id", "ndc"]
    lines = lines.groupBy("post_id", "post_row", *owner, "buyer_id").agg(F.count(F.lit(1)).alias("lines"))
    # A buyer with several addresses has its lines once for each; one without has them once.
    bought = lines.groupBy(*owner, "buyer_id").agg(F.sum("lines").alias("lines"))
    met = bought.join(weighted_states(mk, "buyer_id", "buyer_state"), "buyer_id", "left")
    met = met.withColumn("lines", F.col("lines") * F.coalesce("copies", F.lit(1))).drop("copies")
    traded = met.groupBy(*owner).agg(F.sum("lines").alias("lines"))
    # Different posts are counted by who lists them: posts with the same sellers and products are a number. Nearly always
    # that is one owner, whose markets differ; only what several owners share is made distinct by market.
    rows = with_all_of(lines, "buyer_id", "lines").select("post_id", "post_row", *owner).distinct()
    owners = rows.groupBy("post_id").agg(F.sort_array(F.collect_set(F.struct(*owner))).alias("owners"))
    owners = owners.groupBy("owners").agg(F.count(F.lit(1)).alias("sold"))
    # `sold` is always positive. Asked for here, the choice stays above the shuffle, which both readers then share.
    size = F.when(F.col("sold") > 0, F.size("owners")).alias("size")
    each = owners.select("owners", "sold", size, F.explode("owners").alias("o")).select("owners", "sold", "size", "o.*")
    alone = each.where(F.col("size") == 1).select(*owner, "sold")
    shared = (
        in_market(each.where(F.col("size") > 1).drop("size"))
        .select("owners", "sold", *market)
        .distinct()
        .groupBy(*market)
        .agg(F.sum("sold").alias("sold"))
    )
    buyers = (
        in_market(met.where(F.col("buyer_state").isNotNull()).select(*owner, "buyer_id", "buyer_state"))
        .where(F.col("buyer_state") == F.col("seller_state"))
        .select(*market, "buyer_id")
        .distinct()
        .groupBy(*market)
        .agg(F.count(F.lit(1)).alias("buyers"))
    )
    # One row per seller and product before the joins, for all that adds up; its rows are the distinct sellers.
    by_owner = listed.groupBy(*owner).agg(F.count(F.lit(1)).alias("unsold"))
    for more in (rows.groupBy(*owner).agg((-F.count(F.lit(1))).alias("unsold")), traded, alone):
        by_owner = by_owner.unionByName(more, allowMissingColumns=True)
    by_owner = by_owner.groupBy(*owner).agg(*[F.sum(p).alias(p) for p in ("lines", "sold", "unsold")])
    listings = (
        times(in_market(by_owner), ["lines", "unsold"])
        .groupBy(*market)
        .agg(*[F.sum(p).alias(p) for p in ("lines", "sold", "unsold")], F.count("seller_id").alias("sellers"))
    )
    # Adding up two partial frames instead of joining them keeps groups with a NULL key.
    parts = ("lines", "sold", "buyers", "unsold", "sellers")
    merged = (
        listings.unionByName(shared, allowMissingColumns=True)
        .unionByName(buyers, allowMissingColumns=True)
        .groupBy(*market)
        .agg(*[F.coalesce(F.sum(p), F.lit(0)).alias(p) for p in parts])
        .withColumn("total", F.col("lines") + F.col("unsold"))
    )
    rate = ratio_or_null(F.col("sold"), F.col("total"))
    return (
        merged.where((F.col("total") >= min_posts) & (rate >= min_rate))
        .select(
            F.col("seller_state").alias("State"),
            F.col("drug_group").alias("Drug Category"),
            F.col("ndc").alias("NDC"),
            F.col("total").alias("Total Posts"),
            F.col("sold").alias("Total Sold"),
            rounded(percent_or_null(F.col("sold"), F.col("total")), 2).alias("STR (%)"),
            F.col("sellers").alias("Seller Stores"),
            F.col("buyers").alias("Buyer Stores (Same State)"),
            rounded(ratio_or_null(F.col("sellers"), F.col("buyers")), 2).alias("Seller:Buyer Ratio"),
        )
        .orderBy(F.desc_nulls_first("STR (%)"), F.desc_nulls_first("Total Posts"), "NDC", "State")
    )


def _by_state(lines: DataFrame, mk: Marketplace, store: str, names: tuple[str, str, str, str]) -> DataFrame:
    """Lines, stores and money per state. Stores are added up first, so a hot store never meets
    the join, and the distinct stores are just rows."""
    state, count, unique, revenue = names
    per_store = lines.groupBy(store).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("subtotal").alias("subtotal")
    )
    return (
        times(per_store.join(weighted_states(mk, store, "state"), store), ["lines", "subtotal"])
        .groupBy(F.col("state").alias(state))
        .agg(
            F.sum("lines").alias(count),
            F.count(store).alias(unique),
            F.round(F.sum("subtotal"), 2).alias(revenue),
        )
        .orderBy(F.desc_nulls_first(count), state)
    )


def buyer_state_summary(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    """Purchases by the buyer's state; an invoice's money counts once per item."""
    lines = listed_posts(mk, start, end).join(sold_items(mk, "buyer_id", "subtotal"), "post_id")
    names = ("Buyer State", "Total Purchases", "Unique Buyer Stores", "Total Purchase Revenue")
    return _by_state(lines, mk, "buyer_id", names)


def seller_state_summary(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    """Sales by the state of the post's seller."""
    lines = listed_posts(mk, start, end, "seller_id").join(sold_items(mk, "subtotal"), "post_id")
    names = ("Seller State", "Total Sales", "Unique Seller Stores", "Total Sales Revenue")
    return _by_state(lines, mk, "seller_id", names)


def buyer_stores(mk: Marketplace, start: dt.date, end: dt.date, min_sales: int) -> DataFrame:
    """Savings per buyer. A purchase is dated by its signature, else by its creation."""
    bought = F.coalesce(SIGNED, "created_at")
    signed, created = F.col(SIGNED), F.col("created_at")
    sales = (
        booked_sales(mk, "invoice_id", "buyer_id", SIGNED, "created_at")
        # The range of `bought`, told on the stored columns so that the scan can use it.
        .where(between(signed, start, end) | (signed.isNull() & between(created, start, end)))
        .select("invoice_id", "buyer_id", bought.alias("bought_on"))
    )
    posts = mk.table("posts", "post_id", "ndc", "price", "partial_quantity").where("price IS NOT NULL")
    drugs = mk.table("drugs", "ndc_upc_hri", "package_price", "unit_price").withColumnRenamed("ndc_upc_hri", "ndc")
    saving = savings_strict(F.col("partial_quantity"), F.col("unit_price"), F.col("package_price"), F.col("price"))
    # The saving belongs to the post, so the lines move once for it, not once more for the product.
    priced = posts.join(drugs, "ndc").select("post_id", saving.alias("saving"))
    lines = (
        sales.join(included_items(mk, "invoice_id", "post_id"), "invoice_id")
        .join(priced, "post_id")
        .select("buyer_id", "bought_on", "saving")
    )
    buyers = (
        lines.groupBy("buyer_id")
        .agg(
            F.count(F.lit(1)).alias("posts_bought"),
            F.sum("saving").alias("saved"),
            F.count("saving").alias("savings"),
            F.min("bought_on").alias("first_purchase"),
            F.max("bought_on").alias("last_purchase"),
        )
    )
    stores = weighted_states(mk, "buyer_id", "state", "doing_business_as", how="left")
    met = times(buyers.join(stores, "buyer_id"), ["posts_bought", "saved", "savings"])
    monthly = ratio_or_null(F.col("saved"), span_months(F.col("first_purchase"), F.col("last_purchase")))
    return (
        met.where(F.col("posts_bought") >= min_sales)
        .orderBy(F.desc_nulls_first("saved"), "buyer_id")
        .select(
            F.col("buyer_id").alias("Buyer ID"),
            F.col("doing_business_as").alias("Store Name"),
            F.col("state").alias("State"),
            F.col("posts_bought").alias("Posts Bought"),
            rounded(average(F.col("saved"), F.col("savings")), 2).alias("Avg Savings Per Post"),
            F.round("saved", 2).alias("Total Savings"),
            F.col("first_purchase").alias("First Purchase"),
            F.col("last_purchase").alias("Last Purchase"),
            rounded(monthly, 2).alias("Avg Monthly Savings"),
        )
    )


def drug_analysis(mk: Marketplace, start: dt.date, end: dt.date, min_sales: int) -> DataFrame:
    """Sell-through per product. Product texts join after the aggregation, one row per product."""
    groups = sell_through(listed_posts(mk, start, end, "ndc"), sold_items(mk, SIGNED, "subtotal"), ["ndc"])
    drugs = weighted_drugs(mk, "drug_group", "drug_name", "display_name", "display_packaging")
    rates = sell_through_rates()
    return (
        times(groups.join(drugs, "ndc"), PARTS)
        .where(F.col("sold") >= min_sales)
        .select(
            F.col("drug_group").alias("Drug Category"),
            F.col("ndc").alias("NDC"),
            F.col("display_name").alias("Drug Name"),
            F.col("display_packaging").alias("Packaging"),
            *[value.alias(name) for name, value in rates.items()],
            F.round("revenue", 2).alias("Total Revenue"),
            rounded(average(F.col("revenue"), F.col("revenue_known")), 2).alias("Avg Revenue Per Sale"),
        )
        .orderBy(F.desc_nulls_first("STR (%)"), F.desc_nulls_first("Posts Sold"), "NDC")
    )


def seller_stores(mk: Marketplace, start: dt.date, end: dt.date, min_sales: int) -> DataFrame:
    """Sell-through per seller. The monthly figure spreads the rounded revenue over the posts' span."""
    known = weighted_drugs(mk).withColumnRenamed("copies", "drug_copies")
    posts = listed_posts(mk, start, end, "ndc", "seller_id").join(known, "ndc").drop("ndc")
    groups = sell_through(
        posts,
        sold_items(mk, SIGNED, "subtotal"),
        ["seller_id"],
        of_posts=[F.min("created_at").alias("first_post"), F.max("created_at").alias("last_post")],
        weight="drug_copies",
    )
    stores = weighted_states(mk, "seller_id", "state", "doing_business_as")
    total = F.round("subtotal", 2)
    monthly = ratio_or_null(total, span_months(F.col("first_post"), F.col("last_post")))
    return (
        times(groups.join(stores, "seller_id"), PARTS)
        .where(F.col("sold") >= min_sales)
        .select(
            F.col("seller_id").alias("Seller ID"),
            F.col("doing_business_as").alias("Store Name"),
            F.col("state").alias("State"),
            *[value.alias(name) for name, value in sell_through_rates().items()],
            rounded(average(F.col("subtotal"), F.col("subtotal_known")), 2).alias("Avg Revenue Per Sale"),
            total.alias("Total Revenue"),
            rounded(monthly, 2).alias("Avg Monthly Revenue"),
            F.col("first_post").alias("First Post Date"),
            F.col("last_post").alias("Last Post Date"),
        )
        .orderBy(F.desc_nulls_first("STR (%)"), F.desc_nulls_first("Posts Sold"), "Seller ID")
    )


def state_analysis(mk: Marketplace, start: dt.date, end: dt.date, min_sales: int) -> DataFrame:
    """Sell-through per product group and pair of states. Unsold posts have no buyer state."""
    groups = mk.table("drugs", "ndc_upc_hri", "drug_group").withColumnRenamed("ndc_upc_hri", "ndc")
    posts, sold = listed_posts(mk, start, end, "ndc", "seller_id"), sold_items(mk, "buyer_id", SIGNED, "subtotal")
    # The parts add up, so products and both states join one row per seller, product and buyer, not the lines.
    by_seller = (
        sell_through(posts, sold, ["seller_id", "ndc"], ["buyer_id"])
        .join(groups, "ndc")
        .join(store_states(mk, "seller_id", "seller_state"), "seller_id")
    )
    by_seller = with_matches(by_seller, store_states(mk, "buyer_id", "buyer_state"), "buyer_id", "seller_id", "ndc")
    found = regroup(by_seller, ["drug_group", "seller_state", "buyer_state"])
    return (
        found.where(F.col("sold") >= min_sales)
        .select(
            F.col("drug_group").alias("Drug Category"),
            F.col("buyer_state").alias("Buyer State"),
            F.col("seller_state").alias("Seller State"),
            *[value.alias(name) for name, value in sell_through_rates().items()],
            F.round("revenue", 2).alias("Total Revenue"),
            rounded(average(F.col("revenue"), F.col("revenue_known")), 2).alias("Avg Revenue Per Sale"),
        )
        .orderBy(
            F.desc_nulls_first("STR (%)"), F.desc_nulls_first("Posts Sold"), "Drug Category", "Seller State", "Buyer State"
        )
    )
