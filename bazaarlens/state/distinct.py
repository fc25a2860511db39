"""Counts of different keys that can be added up over months: exact bitmaps over a dictionary of dense numbers.

Every key gets a number once and keeps it; a month's keys are then the bits of a few bitmaps, and the different keys of
any months are the bits of their union. Counting needs the kept bitmaps alone, not the sales.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlens.functions.dates import first_of_month, in_months, month_of
from bazaarlens.operators.activity import both_roles
from bazaarlens.operators.sell_through import booked_sales, store_states
from bazaarlens.sources.marketplace import Marketplace
from bazaarlens.state.monthly import PRINTS, MonthlyTables, prints, taken

SIGNED = "seller_signed_on"


class Numbers:
    """A dictionary of keys (as text) with dense numbers from 1 on, in a folder. It only grows; one writer at a time."""

    LINES = "batch int, keys bigint"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _batches(self) -> list[tuple[int, int]]:
        try:
            lines = self.spark.read.schema(self.LINES).parquet(f"{self.root}/batches")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((r["batch"], r["keys"]) for r in lines.collect())  # a line per extension

    def table(self) -> DataFrame:
        """(key, number) of all keys so far."""
        paths = [f"{self.root}/keys/{b}" for b, _ in self._batches()]
        if not paths:
            return self.spark.createDataFrame([], "key string, number bigint")
        return self.spark.read.schema("key string, number bigint").parquet(*paths)

    def extend(self, keys: Column, rows: DataFrame) -> None:
        """Give numbers to keys that have none yet; NULL gets none.

        New keys are sorted in ranges; the numbers follow from the sizes of the ranges, so no task sees all keys."""
        batches = self._batches()
        number, taken = len(batches) + 1, sum(n for _, n in batches)
        new = rows.select(keys.cast("string").alias("key")).where("key IS NOT NULL").distinct()
        new = new.join(self.table().select("key"), "key", "left_anti").repartitionByRange("key").sortWithinPartitions("key")
        placed = f"{self.root}/placed/{number}"
        new.withColumn("at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(placed)
        ordered = self.spark.read.schema("key string, at bigint").parquet(placed).withColumn("part", F.shiftright("at", 33))
        sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        # A row per range.
        starts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        row = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        numbered = ordered.join(F.broadcast(starts), "part").select("key", (row + F.col("before") + taken + 1).alias("number"))
        numbered.write.mode("overwrite").parquet(f"{self.root}/keys/{number}")
        found = self.spark.read.schema("key string, number bigint").parquet(f"{self.root}/keys/{number}").count()
        if found:
            line = self.spark.createDataFrame([(number, found)], self.LINES)
            line.coalesce(1).write.mode("append").parquet(f"{self.root}/batches")


def bitmaps(rows: DataFrame, *groups: str) -> DataFrame:
    """(groups, bucket, bits): which numbers each group has. Bits are set before the shuffle."""
    return rows.groupBy(*groups, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )


def count_distinct_numbers(maps: DataFrame, *groups: str, name: str = "keys") -> DataFrame:
    """(groups, keys): different numbers in the union of all bitmaps of a group."""
    merged = maps.groupBy(*groups, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*groups).agg(F.sum(F.bitmap_count("bits")).alias(name))


class DistinctState:
    """Monthly bitmaps of a marketplace: active stores, booked invoices, and buyers by their state."""

    TABLES = {"bits": "metric string, state string, bucket bigint, bits binary", "prints": PRINTS}

    def __init__(self, spark: SparkSession, root: str):
        self.stores = Numbers(spark, f"{root}/stores")
        self.invoices = Numbers(spark, f"{root}/invoices")
        self.months = MonthlyTables(spark, f"{root}/months", self.TABLES)

    def refresh(self, mk: Marketplace, start: dt.date, end: dt.date, printed: DataFrame | None = None) -> None:
        """Rebuild the months from start's to end's. A store's state is the one it has now; a store with several
        addresses counts in each state, one without an address in none. The sales are worked out once and stored;
        `printed` are prints taken before, from which later changes differ."""
        span = (first_of_month(start), first_of_month(end, 1))
        sales = self.months.staged("sales", self._sales(mk, span).where(in_months(F.col(SIGNED), start, end)))
        if printed is None:
            printed = prints(sales, SIGNED, "sales")
        sales = sales.withColumn("month", month_of(F.col(SIGNED)))
        active = both_roles(sales, "month").select("store_id", "month", "bought").distinct()
        self.stores.extend(F.col("store_id"), active)
        self.invoices.extend(F.col("invoice_id"), sales)

        def numbered(rows: DataFrame, key: str, numbers: Numbers, metric: str, *more: str) -> DataFrame:
            rows = rows.withColumn("key", F.col(key).cast("string")).join(numbers.table(), "key")
            state = F.col("state") if "state" in more else F.lit(None).cast("string").alias("state")
            return bitmaps(rows.select("month", F.lit(metric).alias("metric"), state, "number"), "month", "metric", "state")

        buyers = active.where("bought").join(store_states(mk, "store_id", "state"), "store_id")
        maps = (
            numbered(active, "store_id", self.stores, "stores")
            .unionByName(numbered(sales, "invoice_id", self.invoices, "invoices"))
            .unionByName(numbered(buyers, "store_id", self.stores, "buyers", "state"))
        )
        self.months.replace({"bits": maps, "prints": printed}, start, end)

    @staticmethod
    def _sales(mk: Marketplace, span: tuple = (None, None)) -> DataFrame:
        return booked_sales(mk, "invoice_id", "buyer_id", "seller_id", SIGNED, signed=span)

    def update(self, mk: Marketplace, start: dt.date | None = None, end: dt.date | None = None) -> None:
        """Rebuild the months (of a range) that are not kept or whose sales have changed since."""
        span = (start and first_of_month(start), end and first_of_month(end, 1))
        now = taken(prints(self._sales(mk, span), SIGNED, "sales"))
        for first, last in self.months.stale_runs(now):
            first, last = max(first, span[0] or first), min(last, end or last)
            if first <= last:
                self.refresh(mk, first, last, now)

    def over_spans(self, spans: DataFrame, metric: str, first: dt.date, last: dt.date, *groups: str) -> DataFrame:
        """Different keys of a metric in each span, a row (first_month, last_month, more columns), from the kept months
        between first and last. A month's bitmaps are read once, however many spans hold it."""
        maps = self.months.table("bits", first, last).where(F.col("metric") == metric)
        step = F.expr("INTERVAL 1 MONTH")
        months = spans.select("*", F.explode(F.sequence("first_month", "last_month", step)).alias("month"))
        names = [*spans.columns, *groups]
        return count_distinct_numbers(months.join(maps, "month"), *names, name=metric)
