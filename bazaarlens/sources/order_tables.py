"""Marketplace relations derived from order, line item, part and customer tables (FIXTURES.md)."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions.dates import month_of, timestamp
from bazaarlens.sources.marketplace import Marketplace, Wanted
from bazaarlens.sources.schema import MONEY

# fixed values: listing status by part key class
LISTING_STATUS = ["ACTIVE", "SOLDOUT", "RESERVED", "DEACTIVATED", "EXPIRED", "DRAFT"]
# Days between the event clock (from 2024-01) and the orders' 1998-03.
SIGN_IN_SHIFT = 9437


def marketplace_from_orders(spark: SparkSession, folder: str) -> Marketplace:
    tables = _OrderTables(spark, folder)
    readers = {n: getattr(tables, n) for n in (
        "sales", "invoices", "invoice_items", "posts", "drugs", "stores", "addresses",
        "funding_accounts", "carts", "users", "monthly_sales_goal",
    )}
    return Marketplace(spark, readers, folder)


def _money(name: str) -> Column:
    return F.col(name).cast(MONEY)


def _hundredths(name: str) -> Column:
    """The stored DOUBLE with two decimals as a whole number; much cheaper than a decimal cast."""
    return F.rint(F.col(name) * 100).cast("bigint")


def _from_cents(cents: Column) -> Column:
    """Whole cents as DECIMAL(18,2), which Spark still keeps in one long."""
    return cents.cast("decimal(15,0)") * F.lit("0.01").cast("decimal(2,2)")


def _pair_id(first: str, second: str) -> Column:
    """Two keys as one id in text, which no key is too large for."""
    return F.concat_ws("-", first, second)


# fixed values: invoice statuses by order status
INVOICE_STATUS = {"F": "COMPLETED", "P": "PENDING", "O": "NOT_STARTED"}
#: A sale is signed on its order's day or up to this much later.
SIGNED_LATER = dt.timedelta(days=10)


def _days(count: Column, hours: Column | int = 0) -> Column:
    hours = hours if isinstance(hours, Column) else F.lit(hours)
    return F.make_dt_interval(count.cast("int"), hours.cast("int"))


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


class _OrderTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}

    def _read(self, name: str, *columns: str) -> DataFrame:
        # The file footer is read once per table, not once per use.
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))
        return self._tables[name].select(*columns)

    def sales(self, asked: Wanted) -> DataFrame:
        # Join first, by shuffle: the rows then lie by order, so grouping them by order and seller
        # moves nothing again; after a broadcast join it would. With a range of days the orders may be
        # few, and the choice is Spark's. Status and signing time are worked out from the group keys
        # afterwards, so that the keys stay narrow.
        lines = self._read("lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
        orders = self._read("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        # What is wanted, said on the stored columns: these filters reach the scan. The exact ones stay above.
        if asked.statuses:
            codes = [c for c, status in INVOICE_STATUS.items() if status in asked.statuses]
            orders = orders.where(F.col("o_orderstatus").isin(codes))
        first, last = asked.signed
        if first is not None:
            orders = orders.where(F.col("o_orderdate") >= timestamp(first - SIGNED_LATER))
        if last is not None:
            orders = orders.where(F.col("o_orderdate") <= timestamp(last))
        if first is None and last is None:
            orders = orders.hint("merge")
        orders = orders.withColumnRenamed("o_orderkey", "l_orderkey")
        net = _hundredths("l_extendedprice") * (F.lit(100) - _hundredths("l_discount"))
        invoice = ["l_orderkey", "l_suppkey", "o_custkey", "o_orderstatus", "o_orderdate"]
        grouped = lines.join(orders, "l_orderkey").groupBy(*invoice).agg(
            F.sum(net).alias("net"), F.max(_hundredths("l_tax")).alias("fee")
        )
        code, order = F.col("o_orderstatus"), F.col("l_orderkey")
        return grouped.select(
            _pair_id("l_orderkey", "l_suppkey").alias("invoice_id"),
            F.col("o_custkey").alias("buyer_id"),
            F.col("l_suppkey").alias("seller_id"),
            # net counts hundredths of a cent
            _from_cents(F.expr("(net + 50) div 100")).alias("subtotal"),
            F.when(order % 17 != 0, F.col("fee").cast("decimal(5,2)")).alias("fee_percent"),
            F.when(code == "F", INVOICE_STATUS["F"])
            .when(code == "P", INVOICE_STATUS["P"])
            .when(code == "O", INVOICE_STATUS["O"])
            .alias("invoice_status"),
            F.col("o_orderdate").alias("created_at"),
            F.when(code != "O", F.col("o_orderdate") + _days(order % 10, order % 24)).alias("seller_signed_on"),
        )

    def invoices(self, asked: Wanted) -> DataFrame:
        return self.sales(asked).select("invoice_id", "buyer_id", "seller_id", "invoice_status", "created_at")

    def invoice_items(self, asked: Wanted) -> DataFrame:
        lines = self._read(
            "lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag"
        )
        cents = _hundredths("l_extendedprice")
        items = lines.select(
            F.concat_ws("-", "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", cents).alias("invoice_item_id"),
            _pair_id("l_orderkey", "l_suppkey").alias("invoice_id"),
            _pair_id("l_partkey", "l_suppkey").alias("post_id"),
            F.when(F.col("l_returnflag") == "R", "REMOVED").otherwise("INCLUDED").alias("status"),
            "l_orderkey",
        )
        if "created_at" in asked:
            orders = self._read("orders", "o_orderkey", "o_orderdate")
            items = items.join(
                orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("created_at")),
                "l_orderkey",
            )
        return items.drop("l_orderkey")

    def posts(self, asked: Wanted) -> DataFrame:
        # Joins on the product or seller would ask for the keys anyway; said here, all readers share the scan.
        lines = self._read("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").where(
            F.col("l_partkey").isNotNull() & F.col("l_suppkey").isNotNull()
        )
        found = [F.min(_hundredths("l_extendedprice")).alias("lowest")]
        if "created_at" in asked:
            orders = self._read("orders", "o_orderkey", "o_orderdate").withColumnRenamed("o_orderkey", "l_orderkey")
            lines = lines.join(orders.hint("merge"), "l_orderkey")
            found.append(F.min("o_orderdate").alias("first_sold"))
        else:
            # Few lines share a listing, so a task that groups what it scans would hold nearly all of it.
            lines = lines.repartition("l_partkey", "l_suppkey")
        posts = lines.groupBy("l_partkey", "l_suppkey").agg(*found)
        if "created_at" in asked:
            posts = posts.withColumn("created_at", F.col("first_sold") - _days(F.col("l_partkey") % 60, 7))
        if "partial_quantity" in asked:
            sizes = self._read("part", "p_partkey", "p_size").withColumnRenamed("p_partkey", "l_partkey")
            size = F.when(F.col("l_partkey") % 3 == 1, F.lit(0)).when(F.col("l_partkey") % 3 == 2, F.col("p_size"))
            posts = posts.join(sizes, "l_partkey").withColumn("partial_quantity", size.cast(MONEY))
        return posts.select(
            "*",
            _pair_id("l_partkey", "l_suppkey").alias("post_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_partkey").alias("ndc"),
            F.when(F.col("l_partkey") % 23 != 0, _from_cents(F.col("lowest"))).alias("price"),
            _pick(F.col("l_partkey") % 6, LISTING_STATUS).alias("status"),
        )

    def drugs(self, asked: Wanted) -> DataFrame:
        parts = self._read("part", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
        return parts.select(
            F.col("p_partkey").alias("ndc_upc_hri"),
            F.col("p_name").alias("drug_name"),
            F.col("p_type").alias("drug_group"),
            F.concat_ws(" ", "p_brand", "p_name").alias("display_name"),
            F.col("p_size").cast("string").alias("display_packaging"),
            (_money("p_retailprice") * 20).cast(MONEY).alias("package_price"),
            _money("p_retailprice").alias("unit_price"),
        )

    def stores(self, asked: Wanted) -> DataFrame:
        customers = self._read("customer", "c_custkey", "c_name", "c_nationkey")
        stores = customers.select(
            F.col("c_custkey").alias("store_id"),
            F.col("c_name").alias("doing_business_as"),
            F.col("c_nationkey").alias("address_id"),
            F.col("c_custkey").alias("funding_id"),
        )
        return self._with_signup(stores, "store_id") if "created_at" in asked else stores

    def _with_signup(self, rows: DataFrame, key: str) -> DataFrame:
        """created_at: the customer's first order (else 1995-01-01) less up to 44 days."""
        first = (
            self._read("orders", "o_custkey", "o_orderdate")
            .groupBy(F.col("o_custkey").alias(key))
            .agg(F.min("o_orderdate").alias("first_order"))
        )
        start = F.coalesce("first_order", F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"))
        joined = rows.join(first, key, "left")
        return joined.withColumn("created_at", start - _days(F.col(key) % 45)).drop("first_order")

    def addresses(self, asked: Wanted) -> DataFrame:
        nations = self._read("nation", "n_nationkey", "n_name")
        return nations.select(F.col("n_nationkey").alias("address_id"), F.col("n_name").alias("state"))

    def funding_accounts(self, asked: Wanted) -> DataFrame:
        accounts = self._read("customer", "c_custkey", "c_mktsegment").select(
            F.col("c_custkey").alias("funding_id"),
            F.when(F.col("c_mktsegment") == "BUILDING", "NOT_STARTED").otherwise("VERIFIED").alias("funding_status"),
        )
        if "created_at" not in asked:
            return accounts
        signed_up = self._with_signup(accounts, "funding_id")
        return signed_up.withColumn("created_at", F.col("created_at") + _days(F.col("funding_id") % 40))

    def carts(self, asked: Wanted) -> DataFrame:
        waiting = self._read("orders", "o_orderstatus", "o_totalprice").where(F.col("o_orderstatus") == "O")
        return waiting.select(_money("o_totalprice").alias("subtotal"))

    def users(self, asked: Wanted) -> DataFrame:
        seen = self._read("events", "user_id", "ts").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
        user = F.col("user_id")
        domain = F.when(user % 7 == 0, "@Staff.Example").otherwise("@shop.example")
        return seen.select(
            user.alias("id"),
            F.concat(F.lit("user"), user.cast("string"), domain).alias("email"),
            F.when(user % 11 != 0, F.col("last_ts") - _days(F.lit(SIGN_IN_SHIFT) + 20 * (user % 5))).alias(
                "last_sign_in_at"
            ),
        )

    def monthly_sales_goal(self, asked: Wanted) -> DataFrame:
        orders = self._read("orders", "o_orderdate", "o_totalprice")
        return orders.groupBy(month_of(F.col("o_orderdate")).alias("month_year")).agg(
            F.sum(_money("o_totalprice")).cast("decimal(28,2)").alias("sales_goal")
        )
