"""Listings against their sales.

The reports see every listing once per sale, and an unsold listing once with empty sale columns.
Written as one outer join, the sales side of a hot listing could not be split. Instead the sold
lines come from an inner join (which can be split), and the unsold listings are counted as all
listing rows less the sold ones. Keys may repeat: a listing row knows its own number, and joins that
would multiply rows carry the number of copies as a weight instead.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.dates import between, whole_days
from bazaarlens.functions.ratios import average, filled, percent_or_null, rounded
from bazaarlens.sources.marketplace import Marketplace, Span

# fixed values: invoice statuses that count as sold, listing statuses that were ever published
BOOKED = ("COMPLETED", "PENDING")
LISTED = ("ACTIVE", "SOLDOUT", "RESERVED", "DEACTIVATED", "EXPIRED")
#: What sell_through adds up.
PARTS = ("made", "sold", "days", "days_known", "revenue", "revenue_known", "subtotal", "subtotal_known")


def booked_sales(mk: Marketplace, *columns: str, signed: Span = (None, None)) -> DataFrame:
    """Sales that are paid or about to be. `signed` tells the source which range the caller keeps."""
    sales = mk.table("sales", "invoice_status", *columns, statuses=BOOKED, signed=signed)
    return sales.where(F.col("invoice_status").isin(*BOOKED))


def completed_sales(mk: Marketplace, *columns: str, signed: Span = (None, None)) -> DataFrame:
    sales = mk.table("sales", "invoice_status", *columns, statuses=("COMPLETED",), signed=signed)
    return sales.where(F.col("invoice_status") == "COMPLETED")


def included_items(mk: Marketplace, *columns: str) -> DataFrame:
    return mk.table("invoice_items", "status", *columns).where(F.col("status") == "INCLUDED").drop("status")


def included_per_invoice(mk: Marketplace) -> DataFrame:
    """(invoice_id, items): one row per invoice, so joining it neither multiplies nor skews."""
    return included_items(mk, "invoice_id").groupBy("invoice_id").agg(F.count(F.lit(1)).alias("items"))


def with_included_items(sales: DataFrame, mk: Marketplace) -> DataFrame:
    """Keep sales that have an INCLUDED item."""
    return sales.join(included_items(mk, "invoice_id").distinct(), "invoice_id", "left_semi")


def sold_items(mk: Marketplace, *sale_columns: str) -> DataFrame:
    """One row per INCLUDED item of a booked sale: post_id and the asked columns of the sale. Where the marketplace keeps
    such lines by post, nothing is joined here, and nothing moves for a join with posts."""
    if mk.has("sold_lines"):
        lines = mk.table("sold_lines", "post_id", "status", "invoice_status", *sale_columns, statuses=BOOKED)
        lines = lines.where(F.col("invoice_status").isin(*BOOKED) & (F.col("status") == "INCLUDED"))
        return lines.select("post_id", *sale_columns)
    sales = booked_sales(mk, "invoice_id", *sale_columns)
    return included_items(mk, "invoice_id", "post_id").join(sales, "invoice_id").select("post_id", *sale_columns)


def listed_posts(mk: Marketplace, start: dt.date, end: dt.date, *columns: str) -> DataFrame:
    """Posts of any published status created in the range (both ends at midnight)."""
    posts = mk.table("posts", "post_id", "status", "created_at", *columns, created=(start, end))
    listed = F.col("status").isin(*LISTED) & between(F.col("created_at"), start, end)
    # A join on the key would ask for it anyway; said here, its other readers share the scan.
    return posts.where(listed & F.col("post_id").isNotNull()).drop("status")


def store_states(mk: Marketplace, store: str, state: str) -> DataFrame:
    """(store, state) for stores with a known address, under the names of the role asked for."""
    return (
        mk.table("stores", "store_id", "address_id")
        .join(mk.table("addresses", "address_id", "state"), "address_id")
        .select(F.col("store_id").alias(store), F.col("state").alias(state))
    )


def weighted_states(mk: Marketplace, store: str, state: str, *more: str, how: str = "inner") -> DataFrame:
    """(store, state, more columns of stores, copies): each combination once, with the number of rows that joining
    stores and addresses gives it. With how="left" stores without an address have a NULL state."""
    addresses = mk.table("addresses", "address_id", "state")
    joined = mk.table("stores", "store_id", "address_id", *more).join(addresses, "address_id", how)
    named = joined.select(F.col("store_id").alias(store), F.col("state").alias(state), *more)
    return named.where(F.col(store).isNotNull()).groupBy(*named.columns).agg(F.count(F.lit(1)).alias("copies"))


def weighted_drugs(mk: Marketplace, *columns: str) -> DataFrame:
    """(ndc, columns, copies): each product with these columns once, with the number of its rows."""
    drugs = mk.table("drugs", "ndc_upc_hri", *columns).withColumnRenamed("ndc_upc_hri", "ndc")
    return drugs.where("ndc IS NOT NULL").groupBy(*drugs.columns).agg(F.count(F.lit(1)).alias("copies"))


def times(parts: DataFrame, measures: Sequence[str], weight: str = "copies") -> DataFrame:
    """The parts with these measures as often as the weight says."""
    scaled = {m: (F.col(m) * F.col(weight)).alias(m) for m in measures}
    return parts.select(*[scaled.get(c, F.col(f"`{c}`")) for c in parts.columns if c != weight])


def numbered(posts: DataFrame) -> DataFrame:
    """Rows with a number of their own, `post_row`: rows that repeat a post_id stay apart from each other."""
    return posts.withColumn("post_row", F.monotonically_increasing_id())


def with_all_of(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows, all of them, for a reader that needs fewer columns than another one of the same rows: asking for the
    same gives both the same shuffles, so Spark runs those once and reuses them."""
    return rows.where(F.xxhash64(*columns) >= F.lit(-(2**63)))


def with_matches(rows: DataFrame, others: DataFrame, key: str, *spread: str) -> DataFrame:
    """Left join on the key. Rows without a key match nothing; they are dealt by the `spread` columns, as a plain join
    would send them all to one task."""
    dealt = F.when(F.col(key).isNull(), F.xxhash64(*spread)).otherwise(F.lit(0).cast("bigint"))
    # Always 0, but no constant, which would not be a key of the join.
    nought = F.pmod(F.xxhash64(key), F.lit(1).cast("bigint"))
    return rows.withColumn("dealt", dealt).join(others.withColumn("dealt", nought), [key, "dealt"], "left").drop("dealt")


def days_to_sale(signed: str = "seller_signed_on", created: str = "created_at") -> Column:
    return whole_days(F.col(signed), F.col(created))


def sell_through(
    posts: DataFrame,
    sold: DataFrame,
    post_keys: Sequence[str],
    sale_keys: Sequence[str] = (),
    of_posts: Sequence[Column] = (),
    weight: str | None = None,
) -> DataFrame:
    """Mergeable sell-through parts per group.

    posts: post_id, created_at, the post_keys and, where rows count more than once, their weight; sold: post_id,
    seller_signed_on, subtotal and the sale_keys. Unsold posts fall in the group whose sale_keys are all NULL. Output:
    the keys, made, sold, days, days_known, revenue, revenue_known (signed lines only), subtotal, subtotal_known
    (all lines), and the of_posts aggregates over all posts of the group.
    """
    keys = [*post_keys, *sale_keys]
    own = [weight] if weight else []
    times_weight = F.col(weight) if weight else F.lit(1)
    signed = F.col("seller_signed_on").isNotNull()
    lines = numbered(posts).join(sold, "post_id").withColumn("days", days_to_sale())
    # Grouped by the key of the join first, so that nothing moves again.
    per_post = lines.groupBy("post_id", "post_row", *own, *keys).agg(
        F.count(F.lit(1)).alias("made"),
        F.count("seller_signed_on").alias("sold"),
        F.sum("days").alias("days"),
        F.count("days").alias("days_known"),
        F.sum(F.when(signed, F.col("subtotal"))).alias("revenue"),
        F.count(F.when(signed, F.col("subtotal"))).alias("revenue_known"),
        F.sum("subtotal").alias("subtotal"),
        F.count("subtotal").alias("subtotal_known"),
    )
    # Sold rows come off the listings counted below. A post sold into several sale_keys groups is still one.
    sums = {m: F.col(m) * times_weight for m in PARTS}
    if not sale_keys:
        sums["made"] = (F.col("made") - 1) * times_weight
    parts = [per_post.groupBy(*keys).agg(*[F.sum(v).alias(m) for m, v in sums.items()])]
    if sale_keys:
        sold_rows = with_all_of(per_post, *PARTS).select("post_id", "post_row", *own, *post_keys).distinct()
        parts.append(sold_rows.groupBy(*post_keys).agg((-F.sum(times_weight)).alias("made")))
    listings = posts.groupBy(*post_keys).agg(F.sum(times_weight).alias("made"), *of_posts)
    extra = [c for c in listings.columns if c not in keys and c != "made"]
    merged = parts[0]
    for more in (*parts[1:], listings):
        merged = merged.unionByName(more, allowMissingColumns=True)
    return merged.groupBy(*keys).agg(
        *[filled(F.sum(m)).alias(m) for m in PARTS], *[F.max(c).alias(c) for c in extra]
    ).where(F.col("made") > 0)


def regroup(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the parts of sell_through up to coarser keys."""
    return parts.groupBy(*keys).agg(*[F.sum(p).alias(p) for p in PARTS])


def sell_through_rates() -> dict[str, Column]:
    """The shared report columns from the parts of sell_through."""
    return {
        "Posts Made": F.col("made"),
        "Posts Sold": F.col("sold"),
        "STR (%)": rounded(percent_or_null(F.col("sold"), F.col("made")), 2),
        "Avg Days to Sale": rounded(average(F.col("days"), F.col("days_known")), 2),
    }
