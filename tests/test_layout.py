"""The stored layout: the same reports, no shuffle under its joins, and only the months of the range."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators.sell_through import booked_sales, included_items, included_per_invoice, listed_posts, sell_through, sold_items
from bazaarlens.plans import revenue, sell_through as reports, snapshot
from bazaarlens.sinks.layout import from_layout, replace_months, write_layout
from shop import shop

START, END = dt.date(1998, 1, 1), dt.date(1998, 4, 30)
AS_OF = dt.date(1998, 3, 20)


def market(spark, n):
    t = dt.datetime(1998, 1, 2)
    sales = [
        {"invoice_id": i, "buyer_id": 1 + i % 7, "seller_id": 20 + i % 5, "subtotal": i, "created_at": t + dt.timedelta(days=i),
         "seller_signed_on": None if i % 11 == 0 else t + dt.timedelta(days=i + 2, hours=5)} for i in range(1, n)
    ]
    items = [{"invoice_item_id": f"{i}-{k}", "invoice_id": i, "post_id": 1 + (i * k) % 40, "created_at": t + dt.timedelta(days=i),
              "status": "REMOVED" if i % 9 == 0 else "INCLUDED"} for i in range(1, n + 5) for k in (1, 2)]
    posts = [{"post_id": p, "seller_id": 20 + p % 5, "ndc": p % 3, "price": p, "created_at": t + dt.timedelta(days=2 * p)} for p in range(1, 50)]
    stores = [{"store_id": s, "address_id": s % 3} for s in range(1, 30)]
    return shop(spark, sales=sales, invoice_items=items, posts=posts, stores=stores,
                addresses=[{"address_id": a, "state": f"S{a}"} for a in range(3)], drugs=[{"ndc_upc_hri": d, "drug_name": str(d)} for d in range(3)])


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    mk = market(spark, 90)
    root = str(tmp_path_factory.mktemp("layout"))
    write_layout(mk, "layout_test", root, 4)
    yield mk, from_layout(spark, "layout_test"), root
    spark.sql("DROP DATABASE layout_test CASCADE")


def reports_of(mk):
    return [
        snapshot.mtd_avg_days(mk, AS_OF), snapshot.mtd_items_sold(mk, AS_OF), revenue.weighted_take_rate(mk, AS_OF),
        reports.drug_analysis(mk, START, END, 1), reports.seller_stores(mk, START, END, 1), reports.benchmark_markets(mk, START, END, 1, 0.0),
    ]


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_reports_are_the_same(both):
    for ours, theirs in zip(reports_of(both[1]), reports_of(both[0])):
        assert ours.collect() == theirs.collect()


def test_joins_move_nothing(both, no_broadcast):
    mk = both[1]
    by_invoice = booked_sales(mk, "invoice_id", "subtotal").join(included_items(mk, "invoice_id", "post_id"), "invoice_id")
    per_invoice = booked_sales(mk, "invoice_id").join(included_per_invoice(mk), "invoice_id")
    by_post = listed_posts(mk, START, END, "seller_id").join(sold_items(mk, "subtotal", "seller_signed_on"), "post_id")
    per_post = by_post.groupBy("post_id", "seller_id").agg(F.count("*"))
    for frame in (by_invoice, per_invoice, by_post, per_post):
        text = plan(frame)
        assert "Join" in text and "Exchange" not in text, text


def test_other_months_are_left_out(both):
    mk = both[1]
    text = plan(booked_sales(mk, "invoice_id", signed=(dt.date(1998, 2, 1), dt.date(1998, 2, 20))))
    assert re.search(r"PartitionFilters: \[.*signed_month.*1998-02-01", text)
    text = plan(listed_posts(mk, dt.date(1998, 2, 1), dt.date(1998, 3, 1)))
    assert re.search(r"PartitionFilters: \[.*created_month.*1998-02-01", text)
    read = listed_posts(mk, dt.date(1998, 2, 1), dt.date(1998, 2, 20)).select(F.input_file_name().alias("f")).distinct().collect()
    assert read and all("created_month=1998-02-01" in r.f for r in read)


def test_months_written_anew(spark, both):
    _, _, root = both
    longer = market(spark, 110)
    replace_months(longer, "layout_test", dt.date(1998, 3, 1), dt.date(1998, 5, 1), 4)
    replace_months(longer, "layout_test", dt.date(1998, 3, 1), dt.date(1998, 5, 1), 4)
    for ours, theirs in zip(reports_of(from_layout(spark, "layout_test")), reports_of(longer)):
        assert ours.collect() == theirs.collect()
