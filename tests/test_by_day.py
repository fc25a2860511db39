"""Reports of many days at once against the single ones, on rows at midnights, repeated and without keys."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators.many_days import distinct_over, month_to_date_runs
from bazaarlens.plans import by_day, churn, snapshot
from shop import shop

D = dt.datetime


@pytest.fixture(scope="module")
def mk(spark):
    sales = [
        {"invoice_id": i, "buyer_id": 1 + i % 4, "seller_id": 10 + i % 3, "subtotal": i,
         "seller_signed_on": D(1998, 1, 1) + dt.timedelta(days=i * 5 // 2, hours=12 * (i % 2))}
        for i in range(1, 45)
    ]
    sales += [
        sales[3], dict(sales[5], seller_signed_on=D(1998, 3, 30)), dict(sales[6], invoice_id=None), dict(sales[7], buyer_id=None),
        dict(sales[8], invoice_id=90, seller_signed_on=None), dict(sales[9], invoice_id=91, seller_id=1, buyer_id=1),
        dict(sales[10], invoice_id=92, invoice_status="PENDING"), dict(sales[11], invoice_id=93, buyer_id=50),
        dict(sales[12], invoice_id=94, seller_id=51, seller_signed_on=D(1998, 3, 1)),
        dict(sales[12], invoice_id=95, seller_id=51, seller_signed_on=D(1998, 3, 31)),
        {"invoice_id": 96, "buyer_id": 52, "seller_id": 53, "seller_signed_on": D(1998, 2, 28), "subtotal": None},
    ]
    items = [{"invoice_id": r["invoice_id"], "post_id": 1 + i % 5, "invoice_item_id": str(i)} for i, r in enumerate(sales)]
    items += [dict(items[2], invoice_item_id="again"), dict(items[3], status="REMOVED")]
    posts = [{"post_id": p, "seller_id": s, "created_at": t} for p, s, t in (
        (1, 10, D(1997, 12, 1)), (2, 11, D(1998, 1, 5, 3)), (3, 60, D(1998, 2, 10)), (4, 60, D(1998, 3, 20)), (5, 61, D(1998, 3, 2)),
        (None, 62, D(1998, 2, 20)),
    )]
    stores = [{"store_id": s} for s in (1, 2, 3, 4, 10, 11, 12, 50, 51, 52, 53, 60, 61, 62, 70, 1, 52)]
    return shop(spark, sales=sales, invoice_items=items, posts=posts, stores=stores)


PAIRS = {
    "active": (by_day.active_stores, snapshot.mtd_active_stores),
    "invoices": (by_day.total_invoices, snapshot.mtd_total_invoices),
    "items": (by_day.items_sold, snapshot.mtd_items_sold),
    "value": (by_day.order_value, snapshot.mtd_aov),
    "days": (by_day.average_days, snapshot.mtd_avg_days),
    "churn": (lambda m, a, b: by_day.churn(m, a, b, 20), lambda m, a: churn.churn_rates(m, a, 20)),
}


@pytest.mark.parametrize("name", PAIRS)
def test_each_day_is_the_single_report(mk, name):
    many, single = PAIRS[name]
    rows = many(mk, dt.date(1998, 2, 26), dt.date(1998, 4, 2)).collect()
    assert [r.as_of for r in rows] == [dt.date(1998, 2, 26) + dt.timedelta(days=i) for i in range(36)]
    for day in (dt.date(1998, 2, 28), dt.date(1998, 3, 1), dt.date(1998, 3, 20), dt.date(1998, 3, 31)):
        found = next(r for r in rows if r.as_of == day)
        want = single(mk, day).first()
        assert [None if v is None else float(v) for v in found[1:]] == [None if v is None else float(v) for v in want], day


def test_a_hot_key_is_a_row_per_slot(spark):
    """Half of all rows belong to one store; it counts once per run."""
    runs = month_to_date_runs(spark, dt.date(1998, 3, 1), dt.date(1998, 3, 31), full_day=True)
    first = (dt.date(1998, 2, 1) - dt.date(1970, 1, 1)).days * 2
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 97).alias("k"), (first + F.col("id") % 118).cast("int").alias("slot")
    )
    counts = {(r.as_of, r.period): r.keys_ for r in distinct_over(runs, rows, "k", "keys_").collect()}
    seen = {(r.k, r.slot) for r in rows.collect()}
    for r in runs.collect():
        assert counts[r.as_of, r.period] == len({k for k, s in seen if r["first"] <= s <= r["last"]})


def test_plans_read_the_sales_once(mk):
    for many in (by_day.active_stores, by_day.total_invoices, by_day.order_value):
        plan = many(mk, dt.date(1998, 3, 1), dt.date(1998, 3, 31))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("seller_signed_on") and plan.count("LogicalRDD") == 1
