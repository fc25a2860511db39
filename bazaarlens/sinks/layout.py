"""A stored marketplace whose large relations lie as the reports join them.

Sales, invoices and items are dealt out and sorted by invoice, posts and sold lines (items with the sale they belong to)
by post, all with the same number of buckets, so joins and groups on these keys move nothing. All are partitioned by
month: sales and sold lines by signing, the others by creation; what a report says of its range leaves out the folders
of other months. The small relations are plain.
"""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions.dates import date, first_of_month, month_of
from bazaarlens.sources.marketplace import Marketplace, Span, Wanted
from bazaarlens.sources.schema import RELATIONS

#: Relation: its key, the time it is partitioned by, and the name of the partition.
LAYOUT = {
    "sales": ("invoice_id", "seller_signed_on", "signed_month"),
    "invoices": ("invoice_id", "created_at", "created_month"),
    "invoice_items": ("invoice_id", "created_at", "created_month"),
    "posts": ("post_id", "created_at", "created_month"),
    "sold_lines": ("post_id", "seller_signed_on", "signed_month"),
}
SALE_COLUMNS = ("buyer_id", "seller_id", "subtotal", "fee_percent", "invoice_status", "seller_signed_on")


def sold_lines(mk: Marketplace) -> DataFrame:
    """Items with the columns of their sale; an item without a sale is none."""
    items = mk.table("invoice_items", "invoice_item_id", "invoice_id", "post_id", "status")
    return items.join(mk.table("sales", "invoice_id", *SALE_COLUMNS), "invoice_id")


def _rows(mk: Marketplace, relation: str) -> DataFrame:
    rows = sold_lines(mk) if relation == "sold_lines" else mk.table(relation, *_columns(relation))
    if relation in LAYOUT:
        _, time, month = LAYOUT[relation]
        rows = rows.withColumn(month, month_of(F.col(time)))
    return rows


def _columns(relation: str) -> list[str]:
    return [part.split()[0] for part in RELATIONS[relation].split(", ")]


def write_layout(mk: Marketplace, database: str, root: str, buckets: int) -> None:
    """Store all relations under root, as tables of a catalog database.

    A bucket of a month is one file; choose the buckets so that one of a usual month has 100 MB or more. Rows without
    the time of their partition lie in a partition of their own."""
    mk.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for relation in [*RELATIONS, "sold_lines"]:
        rows = _rows(mk, relation)
        if relation in LAYOUT:
            key, _, month = LAYOUT[relation]
            # Each task writes one bucket of all months.
            writer = rows.repartition(buckets, key).write.partitionBy(month).bucketBy(buckets, key).sortBy(key)
        else:
            writer = rows.write
        path = f"{root.rstrip('/')}/{relation}"
        writer.mode("overwrite").format("parquet").option("path", path).saveAsTable(f"{database}.{relation}")


def replace_months(mk: Marketplace, database: str, start: dt.date, end: dt.date, buckets: int) -> None:
    """Write the months from start's to end's of the large relations anew; the folders of other months stay."""
    first, last = first_of_month(start), first_of_month(end)
    spark = mk.spark
    for relation, (key, _, month) in LAYOUT.items():
        table = f"{database}.{relation}"
        rows = _rows(mk, relation).where(F.col(month).between(date(first), date(last)))
        # Months that have lost all rows have nothing that would overwrite them.
        kept = {r[0] for r in rows.select(month).distinct().collect()}
        held = [r[0].split("=")[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
        for name in held:
            if name[:2].isdigit() and first <= dt.date.fromisoformat(name) <= last and dt.date.fromisoformat(name) not in kept:
                spark.sql(f"ALTER TABLE {table} DROP PARTITION ({month} = DATE'{name}')")
        order = spark.table(table).columns
        rows = rows.repartition(buckets, key).sortWithinPartitions(key).select(*order)
        with _setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
            rows.write.insertInto(table, overwrite=True)


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting that a table takes from the session only, for as long as it is needed."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _months(month: str, span: Span) -> Column | None:
    first, last = span
    parts = []
    if first is not None:
        parts.append(F.col(month) >= date(first_of_month(first)))
    if last is not None:
        parts.append(F.col(month) <= date(first_of_month(last)))
    return parts[0] & parts[-1] if parts else None


def from_layout(spark: SparkSession, database: str) -> Marketplace:
    """The marketplace that write_layout stored: ranges of signing and creation leave out whole months."""

    def reader(relation: str):
        def read(asked: Wanted) -> DataFrame:
            rows = spark.table(f"{database}.{relation}")
            if relation not in LAYOUT:
                return rows
            _, time, month = LAYOUT[relation]
            within = _months(month, asked.signed if time == "seller_signed_on" else asked.created)
            return (rows if within is None else rows.where(within)).drop(month)

        return read

    return Marketplace(spark, {n: reader(n) for n in [*RELATIONS, "sold_lines"]}, database)
