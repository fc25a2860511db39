"""Borders of days and months in a zone, across clock changes, against local times row by row."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from bazaarlens import Marketplace
from bazaarlens.functions.dates import border
from bazaarlens.plans import churn, overview, revenue, snapshot
from shop import row, shop

UTC = dt.timezone.utc


def test_border():
    assert border(dt.date(1998, 4, 5)) == dt.date(1998, 4, 5)
    assert border(dt.date(1998, 4, 5), "America/Los_Angeles") == dt.datetime(1998, 4, 5, 8)
    assert border(dt.date(1998, 4, 6), "America/Los_Angeles") == dt.datetime(1998, 4, 6, 7)
    assert border(dt.date(1998, 10, 26), "America/Los_Angeles") == dt.datetime(1998, 10, 26, 8)
    assert border(dt.date(2024, 4, 1), "Europe/Berlin") == dt.datetime(2024, 3, 31, 22)
    # midnight is skipped there: the day begins at one
    assert border(dt.date(2017, 10, 15), "America/Sao_Paulo") == dt.datetime(2017, 10, 15, 3)


def moments(*days):
    """Every half hour of a day around the local midnights of these days, in UTC."""
    out = []
    for day in days:
        start = dt.datetime.combine(day, dt.time()) - dt.timedelta(hours=13)
        out += [start + dt.timedelta(minutes=30 * i) for i in range(52)]
    return sorted(set(out))


CASES = [
    # the clocks change within the month, on its last day, and on the day itself
    ("America/Los_Angeles", dt.date(1998, 4, 20)), ("Europe/Berlin", dt.date(2024, 3, 31)), ("America/Los_Angeles", dt.date(1998, 10, 25)),
    ("Asia/Kolkata", dt.date(1998, 4, 1)),
]


@pytest.mark.parametrize("zone, as_of", CASES)
def test_rows_near_local_midnights(spark, zone, as_of):
    first = as_of.replace(day=1)
    before = (first - dt.timedelta(days=1)).replace(day=1)
    after = (first + dt.timedelta(days=31)).replace(day=1)
    day = dt.timedelta(days=1)
    times = moments(before, first, as_of, as_of + day, after, before + (as_of - first), before + (as_of - first) + day)
    sales = [{"invoice_id": i, "buyer_id": i, "seller_id": -1, "subtotal": i, "seller_signed_on": t, "created_at": t} for i, t in enumerate(times)]
    mk = shop(spark, sales=sales, invoices=[{"invoice_id": r["invoice_id"], "created_at": r["created_at"]} for r in sales],
              invoice_items=[{"invoice_item_id": str(i), "invoice_id": i, "created_at": t} for i, t in enumerate(times)])
    local = [t.replace(tzinfo=UTC).astimezone(ZoneInfo(zone)).replace(tzinfo=None) for t in times]

    def held(start, end, closed=False):
        start, end = (dt.datetime.combine(x, dt.time()) for x in (start, end))
        return [i for i, t in enumerate(local) if start <= t < end or (closed and t == end)]

    month, full = held(first, after), held(first, as_of + day)
    found = row(overview.admin_metrics(mk, as_of, borders=zone))
    assert found["total_sales"] == sum(month) and found["prev_total_sales"] == sum(held(before, first))
    assert found["posts_sold"] == len(month)
    active = row(snapshot.mtd_active_stores(mk, as_of, borders=zone))
    midnight = held(first, as_of, closed=True)
    earlier = held(before, before + (as_of - first))
    assert active["active_stores_now"] == len(midnight) + bool(midnight)
    assert active["active_stores_last_month"] == len(earlier) + bool(earlier)
    assert row(revenue.completed_gmv(mk, as_of, borders=zone))["gmv_mtd"] == sum(full)


def test_the_other_tiles_take_borders(spark):
    zone, as_of = "America/Los_Angeles", dt.date(1998, 4, 20)
    # 06:30 UTC is the evening before there: in March, and in the night before the next day
    late = [{"invoice_id": 1, "seller_signed_on": dt.datetime(1998, 4, 1, 6, 30)}, {"invoice_id": 2, "buyer_id": 7, "seller_signed_on": dt.datetime(1998, 4, 21, 6, 30)}]
    mk = shop(spark, sales=late, invoice_items=[{"invoice_id": 1}, {"invoice_item_id": "b", "invoice_id": 2}],
              posts=[{"created_at": dt.datetime(1998, 4, 1, 6, 30)}, {"post_id": 2, "created_at": dt.datetime(1998, 3, 1)}],
              stores=[{"store_id": 7, "created_at": dt.datetime(1998, 4, 2)}, {"store_id": 1, "created_at": dt.datetime(1998, 4, 1, 6, 30)}])
    assert row(snapshot.mtd_activation(mk, as_of, borders=zone)) == {"total_new_stores": 1, "activated_stores": 1, "activation_rate": 1.0}
    assert row(snapshot.mtd_activation(mk, as_of))["total_new_stores"] == 2
    assert row(snapshot.mtd_active_posts(mk, as_of, borders=zone))["active_last_month"] == 2
    assert row(snapshot.mtd_active_posts(mk, as_of))["active_last_month"] == 1
    assert row(snapshot.mtd_aov(mk, as_of, borders=zone))["aov_current"] == 100
    mix = {r.seller_type: r.revenue_mtd for r in revenue.revenue_mix(mk, as_of, borders=zone).collect()}
    assert mix == {"Existing": 5.0, "New": 0.0}
    assert {r.seller_type: r.revenue_mtd for r in revenue.revenue_mix(mk, as_of).collect()} == {"Existing": 0.0, "New": 5.0}
    assert row(revenue.gmv_retention_mtd(mk, as_of, borders=zone))["gmv_retention_pct_current_month"] == 1.0
    assert row(churn.churn_rates(mk, dt.date(1998, 4, 30), 30, borders=zone))["Buyer Churn (%)"] == 100.0


def test_borders_reach_the_scan(spark, tmp_path):
    shop(spark, sales=[{}]).table("sales").write.parquet(f"{tmp_path}/sales")
    mk = Marketplace.from_parquet(spark, str(tmp_path))
    tile = snapshot.mtd_total_invoices(mk, dt.date(1998, 4, 20), borders="America/Los_Angeles")
    plan = tile._jdf.queryExecution().executedPlan().toString()
    assert "seller_signed_on,1998-0" in plan[plan.index("PushedFilters") :]
