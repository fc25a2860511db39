"""Tiles and churn for every day of a range at once: each row is what the report of that day says."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions.dates import timestamp
from bazaarlens.functions.ratios import average, growth, percent_or_null, ratio_or_zero, rounded
from bazaarlens.operators.activity import both_roles
from bazaarlens.operators.many_days import (
    covered,
    day_number,
    distinct_over,
    month_to_date_runs,
    running_counts,
    side_by_side,
    slot_of,
    sums_over,
)
from bazaarlens.operators.sell_through import (
    booked_sales,
    completed_sales,
    days_to_sale,
    included_items,
    included_per_invoice,
)
from bazaarlens.sources.marketplace import Marketplace

SIGNED = "seller_signed_on"


def _sales(mk: Marketplace, start: dt.date, end: dt.date, *columns: str) -> DataFrame:
    first, last = covered(start, end)
    sales = booked_sales(mk, SIGNED, *columns, signed=(first, last))
    kept = sales.where((F.col(SIGNED) >= timestamp(first)) & (F.col(SIGNED) <= timestamp(last)))
    return kept.withColumn("slot", slot_of(F.col(SIGNED)))


def _with_growth(pairs: DataFrame, name: str, now: str, before: str) -> DataFrame:
    change = rounded(growth(F.col(f"{name}_now"), F.col(f"{name}_before")), 4)
    return pairs.select(
        "as_of", F.col(f"{name}_now").alias(now), F.col(f"{name}_before").alias(before),
        change.alias("current_vs_last_month_pct"),
    ).orderBy("as_of")


def active_stores(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    runs = month_to_date_runs(mk.spark, start, end, full_day=False)
    rows = both_roles(_sales(mk, start, end, "buyer_id", "seller_id"), "slot")
    pairs = side_by_side(distinct_over(runs, rows, "store_id"), "keys")
    return _with_growth(pairs, "keys", "active_stores_now", "active_stores_last_month")


def total_invoices(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    runs = month_to_date_runs(mk.spark, start, end, full_day=False)
    pairs = side_by_side(distinct_over(runs, _sales(mk, start, end, "invoice_id"), "invoice_id"), "keys")
    return _with_growth(pairs, "keys", "mtd_completed_invoices", "last_month_completed_invoices")


def items_sold(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    runs = month_to_date_runs(mk.spark, start, end, full_day=False)
    rows = _sales(mk, start, end, "invoice_id").join(included_per_invoice(mk), "invoice_id")
    pairs = side_by_side(sums_over(runs, rows, items=F.col("items")), "items")
    return _with_growth(pairs, "items", "items_sold_now", "items_sold_last_month")


def order_value(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    runs = month_to_date_runs(mk.spark, start, end, full_day=True)
    one = F.when(F.col("invoice_id").isNotNull(), 1).otherwise(0)
    sums = sums_over(runs, _sales(mk, start, end, "invoice_id", "subtotal"), total=F.col("subtotal"), invoices=one)
    now, before = (
        ratio_or_zero(F.col(f"total_{p}"), F.col(f"invoices_{p}")) for p in ("now", "before")
    )
    return side_by_side(sums, "total", "invoices").select(
        "as_of", rounded(now, 2).alias("aov_current"), rounded(before, 2).alias("aov_last_month"),
        rounded(growth(now, before), 4).alias("growth_pct"),
    ).orderBy("as_of")


def average_days(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    runs = month_to_date_runs(mk.spark, start, end, full_day=False)
    lines = (
        _sales(mk, start, end, "invoice_id")
        .join(included_items(mk, "invoice_id", "post_id"), "invoice_id")
        .join(mk.table("posts", "post_id", "created_at"), "post_id")
        .withColumn("days", days_to_sale())
    )
    known = F.when(F.col("days").isNotNull(), 1).otherwise(0)
    pairs = side_by_side(sums_over(runs, lines, days=F.col("days"), lines=known), "days", "lines")
    means = pairs.select(
        "as_of",
        rounded(average(F.col("days_now"), F.col("lines_now")), 2).alias("avg_days_to_sell_now"),
        rounded(average(F.col("days_before"), F.col("lines_before")), 2).alias("avg_days_to_sell_last_month"),
    )
    change = growth(F.col("avg_days_to_sell_now"), F.col("avg_days_to_sell_last_month"))
    return means.select("*", rounded(change, 4).alias("avg_days_to_sell_change_pct")).orderBy("as_of")


# What makes a store a base of a rate, and which days are a hit: nothing of a kind from then on, or just one item.
ROLES = {"sold": ["sale"], "bought": ["purchase"], "any": ["sale", "purchase", "post"], "seller": ["sale", "post"]}
RATES = {
    "Seller Churn (%)": ("sold", "no_offer"),
    "Buyer Churn (%)": ("bought", "no_purchase"),
    "Overall Churn (%)": ("any", "nothing"),
    "One-timer (%)": ("any", "one_trade"),
    "One-time Buyer (%)": ("bought", "one_purchase"),
    "One-time Seller (%)": ("seller", "one_sale"),
}
NEVER, ALWAYS = -(10**9), 10**9


def _hit_days(events: DataFrame) -> DataFrame:
    """Per store and hit the days (after, upto] from which on the store has nothing more, or just one item.

    An item counts from a day on if its last event is on that day or later; so one item is left between the last
    events of the last item and of the one before it."""
    lasts = events.where("item IS NOT NULL").groupBy("store_id", "role", "item").agg(F.max("day").alias("day"))
    groups = F.when(F.col("role") == "post", F.array(F.lit("post"))).otherwise(F.array(F.col("role"), F.lit("trade")))
    by_day = (
        lasts.select("store_id", F.explode(groups).alias("g"), "day")
        .groupBy("store_id", "g", "day")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # A row per store and day, so no store is large here.
    latest = Window.partitionBy("store_id", "g").orderBy(F.desc("day"))
    top = by_day.withColumn("place", F.row_number().over(latest)).where("place <= 2")

    def last(*groups: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("g").isin(*groups) & (F.col("place") == 1), F.col("day"))), F.lit(NEVER))

    def second(group: str) -> Column:
        # Two items with the same last day leave no day with one.
        mine = F.col("g") == group
        many = F.max(F.when(mine & (F.col("place") == 1) & (F.col("n") > 1), F.col("day")))
        return F.coalesce(many, F.max(F.when(mine & (F.col("place") == 2), F.col("day"))), F.lit(NEVER))

    rows = top.groupBy("store_id").agg(
        last("sale", "post").alias("no_offer"), last("purchase").alias("no_purchase"), last("trade", "post").alias("nothing"),
        *[c for g in ("trade", "purchase", "sale") for c in (second(g).alias(f"after_{g}"), last(g).alias(f"one_{g}"))],
    )
    open_end = F.lit(ALWAYS)
    return rows.select(
        "store_id",
        *[F.struct(F.col(h).alias("after"), open_end.alias("upto")).alias(h) for h in ("no_offer", "no_purchase", "nothing")],
        *[
            F.struct(F.col(f"after_{g}").alias("after"), F.col(f"one_{g}").alias("upto")).alias(f"one_{g}")
            for g in ("trade", "purchase", "sale")
        ],
    )


def churn(mk: Marketplace, start: dt.date, end: dt.date, window_days: int) -> DataFrame:
    """The six rates of the churn report for every day. Each active day of a store makes it a base for window_days, or
    till its next active day; where that meets the days of a hit, the hit counts. Only days on which counts change are
    summed."""
    # The current period of a day starts here, and is open.
    back = dt.timedelta(days=window_days - 1)
    first, last = ((d - back - dt.date(1970, 1, 1)).days for d in (start, end))
    since = start - back - dt.timedelta(days=window_days)
    signed, created = F.col(SIGNED), F.col("created_at")
    sales = completed_sales(mk, "invoice_id", "buyer_id", "seller_id", SIGNED, signed=(since, None))
    trades = both_roles(sales.where(signed >= timestamp(since)), "invoice_id", SIGNED)
    posts = mk.table("posts", "post_id", "seller_id", "created_at", created=(since, None)).where(created >= timestamp(since))
    events = trades.select(
        "store_id", F.when(F.col("bought"), "purchase").otherwise("sale").alias("role"),
        F.col("invoice_id").cast("string").alias("item"), day_number(signed).alias("day"),
    ).unionByName(
        posts.select(
            F.col("seller_id").alias("store_id"), F.lit("post").alias("role"),
            F.col("post_id").cast("string").alias("item"), day_number(created).alias("day"),
        )
    ).where("store_id IS NOT NULL")
    bases = F.array_compact(F.array(*[F.when(F.col("role").isin(r), F.lit(b)) for b, r in ROLES.items()]))
    active = (
        events.where(F.col("day") < last).select("store_id", F.explode(bases).alias("base"), "day").distinct()
    )
    following = F.lead("day").over(Window.partitionBy("store_id", "base").orderBy("day"))
    until = F.least(F.col("day") + window_days, F.coalesce(following, F.lit(ALWAYS)), F.lit(last))
    spans = active.select(
        "store_id", "base", F.greatest(F.col("day") + 1, F.lit(first)).alias("a"), until.alias("b")
    ).where("a <= b")
    copies = mk.table("stores", "store_id").groupBy("store_id").agg(F.count(F.lit(1)).alias("copies"))
    known = spans.join(copies, "store_id").join(_hit_days(events), "store_id", "left")

    def span(name: str, a: Column, b: Column, holds: Column) -> Column:
        """The changes that an interval of days makes."""
        come = F.struct(F.lit(name).alias("name"), a.alias("day"), F.col("copies").alias("n"))
        go = F.struct(F.lit(name).alias("name"), (b + 1).alias("day"), (-F.col("copies")).alias("n"))
        return F.when(holds & (a <= b), F.array(come, go))

    a, b = F.col("a"), F.col("b")
    parts = [span(base, a, b, F.col("base") == base) for base in ROLES]
    for rate, (base, hit) in RATES.items():
        after, upto = F.coalesce(F.col(f"{hit}.after"), F.lit(NEVER)), F.col(f"{hit}.upto")
        # Without a known item there is nothing to have, and nothing to have once.
        upto = F.coalesce(upto, F.lit(NEVER if hit.startswith("one_") else ALWAYS))
        parts.append(span(rate, F.greatest(a, after + 1), F.least(b, upto), F.col("base") == base))
    changes = known.select(F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("c")).select("c.*")
    names = {n: f"c{i}" for i, n in enumerate([*ROLES, *RATES])}
    counts = running_counts(changes.replace(names, subset="name"), mk.spark, first, last, *names.values())
    return counts.select(
        F.date_from_unix_date(F.col("day") + (window_days - 1)).alias("as_of"),
        *[
            rounded(percent_or_null(F.col(names[rate]), F.nullif(F.col(names[base]), F.lit(0))), 2).alias(rate)
            for rate, (base, _) in RATES.items()
        ],
    ).orderBy("as_of")
