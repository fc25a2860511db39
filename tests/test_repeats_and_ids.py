"""Sale rows that repeat, ids beyond 64 bits, and filters on the derived relations."""

import datetime as dt
import re

import pytest

from bazaarlens.operators.churn import churn_flags
from bazaarlens.operators.periods import trailing_pair
from bazaarlens.plans import kpi
from bazaarlens.plans.catalog import PLANS, ReportArgs
from bazaarlens.sources.order_tables import marketplace_from_orders
from shop import row, rows, shop

RANGE = (dt.date(1998, 3, 1), dt.date(1998, 3, 31))


def test_a_sale_given_twice_counts_twice(spark):
    mk = shop(spark, sales=[{}, {}], invoice_items=[{}], posts=[{}], drugs=[{}])
    buyers, sellers = row(kpi.buyers_kpi(mk, *RANGE)), row(kpi.sellers_kpi(mk, *RANGE))
    for r, units in ((buyers, "Units Bought"), (sellers, "Units Sold")):
        assert (r["GMV ($)"], r["Total Transactions"], r[units]) == (200, 2, 4)
    assert buyers["Total Savings ($)"] == 4 * 30
    assert sellers["Net Revenue ($)"] == 10


def test_different_rows_of_an_invoice(spark):
    sales = [{"subtotal": 100}, {"subtotal": 100}, {"subtotal": 60, "buyer_id": 5}, {"invoice_id": 2, "subtotal": 7}]
    items = [{}, {"invoice_item_id": "b", "post_id": 9}, {"invoice_item_id": "c", "invoice_id": 2}]
    mk = shop(spark, sales=sales, invoice_items=items, posts=[{}], drugs=[])
    r = row(kpi.buyers_kpi(mk, *RANGE))
    # Invoice 1: one item has a post; three rows, each with three lines. Invoice 2: one row, one line.
    assert (r["GMV ($)"], r["Total Transactions"], r["Units Bought"], r["Active Buyers"]) == (267, 4, 10, 2)
    assert r["Total Savings ($)"] == -20 * 10
    assert row(kpi.sellers_kpi(mk, *RANGE))["Units Sold"] == 3 * 6 + 1


def test_churn_counts_every_invoice(spark):
    mk = shop(spark, sales=[{"invoice_id": i} for i in (1, 2, 3, 3)], posts=[])
    found = {r["store_id"]: r for r in rows(churn_flags(mk.table("sales"), mk.table("posts"), trailing_pair(dt.date(1998, 3, 31), 30)))}
    assert found[1]["purchases"] == 3 and found[2]["sales"] == 3 and found[2]["posts"] == 0


def test_large_keys_stay_apart(spark, tmp_path):
    line = "l_orderkey bigint, l_suppkey bigint, l_partkey bigint, l_linenumber int, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    keys = [(10**10, 10**9), (10**10 + 1, 0), (9 * 10**18, 9 * 10**18)]
    spark.createDataFrame([(o, s, 1, 1, 10.0, 0.0, 0.05, "N") for o, s in keys], line).write.parquet(str(tmp_path / "lineitem.parquet"))
    moment = dt.datetime(1998, 3, 1)
    orders = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_totalprice double"
    spark.createDataFrame([(o, 1, "F", moment, 10.0) for o, _ in keys], orders).write.parquet(str(tmp_path / "orders.parquet"))
    mk = marketplace_from_orders(spark, str(tmp_path))
    ids = {r["invoice_id"] for r in rows(mk.table("sales", "invoice_id"))}
    assert ids == {f"{o}-{s}" for o, s in keys}
    assert {r["invoice_id"] for r in rows(mk.table("invoice_items", "invoice_id"))} == ids


PRUNED = [
    "r06_mtd_activation", "r08_mtd_active_stores", "r09_mtd_aov", "r10_mtd_avg_days", "r11_mtd_items_sold",
    "r12_mtd_total_invoices", "r13_completed_gmv", "r14_completed_revenue", "r15_pending_gmv", "r16_pending_revenue",
    "r17_weighted_take_rate", "r18_revenue_mix", "r19_gmv_retention_mtd", "r05_churn", "m01_", "m02_", "m03_", "m04_", "m05_",
    "m13_churn_flags",
]


@pytest.mark.parametrize("name", PRUNED)
def test_range_and_status_reach_the_orders(spark, name):
    name = next(n for n in PLANS if n.startswith(name))
    text = PLANS[name](marketplace_from_orders(spark, "/root/testdata/sf0.001"), ReportArgs())._jdf.queryExecution()
    text = text.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = [
        next(x for x in p.splitlines() if x.startswith("PushedFilters"))
        for p in text.split("\n\n") if "Scan parquet" in p and re.search(r"/orders\.parquet\]", p)
    ]
    assert any("o_orderstatus" in x and re.search(r"(Than|OrEqual)\(o_orderdate", x) for x in pushed), pushed
