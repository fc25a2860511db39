"""What the reports need to know of all history, kept per store and month.

Four tables by month: who bought and sold, and when a seller's first completed sale was (traders); money and rows per
seller (sellers); different invoices (orders); and first completed invoices in either role (customers). All are folded
from the sales and invoices of a month alone, so a month is rebuilt from its own rows; first months and retention follow
from the kept months. `prints` holds a count and a sum of hashes per month, by which months with late or changed rows
are found without touching the state.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions.dates import first_of_month, in_months, month_of, timestamp
from bazaarlens.operators.activity import both_roles
from bazaarlens.operators.sell_through import BOOKED
from bazaarlens.sources.marketplace import Marketplace
from bazaarlens.state.monthly import PRINTS, MonthlyTables, prints, taken

SIGNED = "seller_signed_on"
# A fee times money has a scale of four.
TABLES = {
    "traders": "store_id bigint, bought boolean, sold boolean, first_completed timestamp_ntz",
    "sellers": "seller_id bigint, gmv decimal(28,2), points decimal(38,4), rows bigint",
    "orders": "orders bigint",
    "customers": "store_id bigint, first_created timestamp_ntz",
    "prints": PRINTS,
}


def folded_sales(sales: DataFrame) -> DataFrame:
    """Booked sale rows by month, with identical ones folded into one that knows its number of `copies`."""
    folded = sales.select(
        "invoice_id", "seller_id", "fee_percent", "subtotal", month_of(F.col(SIGNED)).alias("month")
    ).where("month IS NOT NULL")
    # `copies` is always positive. Asking for it, and for the month above, gives both readers of
    # this frame the same shuffle, so Spark runs it once and reuses it.
    return folded.groupBy(*folded.columns).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 0)


def seller_months(folded: DataFrame) -> DataFrame:
    """(seller_id, month, gmv, points, rows); a NULL seller is one of them."""
    return folded.groupBy("seller_id", "month").agg(
        F.sum("subtotal").alias("gmv"),
        F.sum(F.col("subtotal") * F.col("fee_percent")).alias("points"),
        F.sum("copies").alias("rows"),
    )


def month_orders(folded: DataFrame) -> DataFrame:
    """(month, orders): different invoices."""
    return folded.groupBy("month").agg(F.count_distinct("invoice_id").alias("orders"))


class ActivityState:
    """The kept tables of a marketplace in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.tables = MonthlyTables(spark, root, TABLES)

    def refresh(
        self, mk: Marketplace, start: dt.date, end: dt.date, printed: DataFrame | None = None,
        stored: tuple[DataFrame, DataFrame] | None = None,
    ) -> None:
        """Rebuild the months from start's to end's from their own rows: by signing for sales, by creation for invoices.
        The sales are worked out once and stored, as several tables read them. `printed` are prints taken before: rows
        that have changed since then differ from them, and their months are found again. `stored` are sales and invoices
        that the caller has stored already."""
        if stored is None:
            span = (first_of_month(start), first_of_month(end, 1))
            sales = self.tables.staged("sales", self._sales(mk, span).where(in_months(F.col(SIGNED), start, end)))
            invoices = self._invoices(mk)
        else:
            sales, invoices = stored
            sales = sales.where(in_months(F.col(SIGNED), start, end))
        invoices = invoices.where(in_months(F.col("created_at"), start, end))
        booked = sales.where(F.col("invoice_status").isin(*BOOKED))
        folded = folded_sales(booked)
        completed = F.when(F.col("invoice_status") == "COMPLETED", F.col(SIGNED))
        traders = (
            both_roles(booked, SIGNED, "invoice_status")
            .where("store_id IS NOT NULL")
            .groupBy("store_id", month_of(F.col(SIGNED)).alias("month"))
            .agg(
                F.max("bought").alias("bought"), F.max("sold").alias("sold"),
                F.min(F.when(F.col("sold"), completed)).alias("first_completed"),
            )
        )
        customers = (
            both_roles(invoices.where(F.col("invoice_status") == "COMPLETED"), "created_at")
            .where("store_id IS NOT NULL")
            .groupBy("store_id", month_of(F.col("created_at")).alias("month"))
            .agg(F.min("created_at").alias("first_created"))
        )
        if printed is None:
            printed = prints(sales, SIGNED, "sales").unionByName(prints(invoices, "created_at", "invoices"))
        self.tables.replace(
            {
                "traders": traders, "sellers": seller_months(folded), "orders": month_orders(folded),
                "customers": customers, "prints": printed,
            },
            start, end,
        )

    @staticmethod
    def _sales(mk: Marketplace, span: tuple = (None, None)) -> DataFrame:
        columns = ("invoice_id", "buyer_id", "seller_id", "subtotal", "fee_percent", "invoice_status", SIGNED)
        return mk.table("sales", *columns, signed=span)

    @staticmethod
    def _invoices(mk: Marketplace) -> DataFrame:
        return mk.table("invoices", "buyer_id", "seller_id", "invoice_status", "created_at")

    def update(self, mk: Marketplace) -> list[tuple[dt.date, dt.date]]:
        """Rebuild the months whose rows are not those that the state was built from; returns them as runs. One scan of
        sales and invoices, and a shuffle of one row per month and task, find them; the prints are kept with the months.
        A state without any month needs all rows, so these are stored first and worked out just once."""
        sales, invoices, stored = self._sales(mk), self._invoices(mk), None
        if not self.tables.batches():
            sales = self.tables.staged("sales", sales.where(F.col(SIGNED).isNotNull()))
            invoices = self.tables.staged("invoices", invoices.where("created_at IS NOT NULL"))
            stored = (sales, invoices)
        now = taken(prints(sales, SIGNED, "sales").unionByName(prints(invoices, "created_at", "invoices")))
        runs = self.tables.stale_runs(now)
        for first, last in runs:
            self.refresh(mk, first, last, now, stored)
        return runs

    # What the reports read

    def seller_months(self, end: dt.date) -> DataFrame:
        return self.tables.table("sellers", None, end)

    def month_orders(self, end: dt.date) -> DataFrame:
        return self.tables.table("orders", None, end)

    def active_months(self, end: dt.date) -> DataFrame:
        """(store_id, month, bought, sold) up to end's month."""
        return self.tables.table("traders", None, end).drop("first_completed")

    def first_completed_sales(self, before: dt.date) -> DataFrame:
        """(seller_id, first): sellers with a completed sale before the midnight of a day, and the earliest one."""
        rows = self.tables.table("traders", None, before).where(F.col("first_completed") < timestamp(before))
        return rows.groupBy(F.col("store_id").alias("seller_id")).agg(F.min("first_completed").alias("first"))

    def first_invoices(self, before: dt.date) -> DataFrame:
        """(store_id, first): stores with a completed invoice before the midnight of a day, and the earliest one."""
        rows = self.tables.table("customers", None, before).where(F.col("first_created") < timestamp(before))
        return rows.groupBy("store_id").agg(F.min("first_created").alias("first"))
