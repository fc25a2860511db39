"""Daily new customers and new signups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.dates import date, day_of, on_days, timestamp
from bazaarlens.operators.activity import both_roles, first_activity
from bazaarlens.operators.spines import day_spine, fill_spine
from bazaarlens.sources.marketplace import Marketplace
from bazaarlens.state.activity import ActivityState


def _first_invoices(mk: Marketplace, before: dt.date) -> DataFrame:
    completed = mk.table(
        "invoices", "buyer_id", "seller_id", "invoice_status", "created_at", statuses=("COMPLETED",),
        created=(None, before),
    ).where(
        (F.col("invoice_status") == "COMPLETED") & (F.col("created_at") < timestamp(before))
    )
    return first_activity(both_roles(completed, "created_at").where("store_id IS NOT NULL"), "store_id", "created_at")


def new_customers(mk: Marketplace, start: dt.date, end: dt.date, state: ActivityState | None = None) -> DataFrame:
    """Stores by the day of their first completed invoice in either role, over all history (or the kept state of it)."""
    # A later invoice cannot move a first day that lies in the range.
    before = end + dt.timedelta(days=1)
    first = state.first_invoices(before) if state is not None else _first_invoices(mk, before)
    first = first.select(day_of(F.col("first")).alias("customer_date"))
    daily = (
        first.where(F.col("customer_date") >= date(start))
        .groupBy("customer_date")
        .agg(F.count(F.lit(1)).alias("new_customers"))
    )
    spine = day_spine(mk.spark, start, end, "customer_date")
    return fill_spine(spine, "customer_date", daily, zero={"new_customers": 0}).orderBy("customer_date")


def new_signups(mk: Marketplace, start: dt.date, end: dt.date) -> DataFrame:
    daily = (
        mk.table("stores", "store_id", "created_at")
        .where(on_days(F.col("created_at"), start, end))
        .groupBy(day_of(F.col("created_at")).alias("signup_date"))
        .agg(F.count(F.lit(1)).alias("new_store_signups"))
    )
    spine = day_spine(mk.spark, start, end, "signup_date")
    return fill_spine(spine, "signup_date", daily, zero={"new_store_signups": 0}).orderBy("signup_date")
