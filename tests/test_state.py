"""Reports from the state kept by month equal those from all sales, whatever came late, twice or not at all."""

import datetime as dt

import pytest

from bazaarlens import Marketplace
from bazaarlens.plans import ops, revenue, signups, snapshot
from bazaarlens.plans.from_state import built_state
from bazaarlens.sources.order_tables import marketplace_from_orders
from bazaarlens.state.activity import ActivityState
from bazaarlens.state.monthly import MonthlyTables
from shop import shop

START, END = dt.date(1998, 1, 1), dt.date(1998, 6, 30)
REPORTS = {
    "new_customers": lambda mk, **s: signups.new_customers(mk, START, END, **s),
    "revenue": lambda mk, **s: ops.revenue_report(mk, START, END, **s),
    "stores": lambda mk, **s: ops.user_store_report(mk, START, END, **s),
    "mix": lambda mk, **s: revenue.revenue_mix(mk, dt.date(1998, 4, 10), **s),
    "activation": lambda mk, **s: snapshot.mtd_activation(mk, dt.date(1998, 4, 10), **s),
}


def at(month, day=5, hour=10):
    return dt.datetime(1998, month, day, hour)


def sale(i, month, **given):
    made = {"invoice_id": i, "buyer_id": i % 5, "seller_id": 10 + i % 3, "subtotal": 10 * i, "created_at": at(month),
            "seller_signed_on": at(month, 1 + i % 28)}
    return made | given


SALES = [
    *[sale(i, 1 + i % 6) for i in range(1, 40)],
    sale(50, 2, seller_id=None), sale(51, 4, buyer_id=None, seller_id=None), sale(52, 4, subtotal=None),
    sale(53, 4, fee_percent=None), sale(54, 4, invoice_status="PENDING", seller_id=77), sale(55, 3, invoice_status="VOID"),
    sale(56, 5, seller_signed_on=None), sale(57, 4, seller_id=77, seller_signed_on=at(4, 20)),
    sale(58, 4, seller_id=78, seller_signed_on=dt.datetime(1998, 4, 11)), sale(7, 2), sale(7, 2),
]
LATE = [sale(60, 2, seller_id=77), sale(61, 1, seller_id=79, buyer_id=6), sale(62, 4, seller_id=79), sale(63, 4, buyer_id=80)]
STORES = [{"store_id": s, "created_at": at(m)} for s, m in ((1, 4), (2, 1), (6, 1), (77, 4), (78, 4), (79, 4), (80, 4))]


def market(spark, sales):
    invoices = [{k: r[k] for k in ("invoice_id", "buyer_id", "seller_id", "created_at")} | (
        {"invoice_status": r["invoice_status"]} if "invoice_status" in r else {}) for r in sales]
    items = [{"invoice_id": r["invoice_id"]} for r in sales]
    mk = shop(spark, sales=sales, invoices=invoices, invoice_items=items, stores=STORES)
    mk.known = {}
    return mk


def same(mk, state, *names):
    for name in names or REPORTS:
        if name not in mk.known:
            mk.known[name] = REPORTS[name](mk).collect()
        assert REPORTS[name](mk, state=state).collect() == mk.known[name], name


def test_late_rows_repeats_and_null_stores(spark, tmp_path):
    before, after = market(spark, SALES), market(spark, SALES + LATE)
    state = ActivityState(spark, str(tmp_path))
    for first, last in ((1, 2), (3, 3), (4, 6)):
        state.refresh(before, dt.date(1998, first, 1), dt.date(1998, last, 28))
    same(before, state)
    # a month run twice
    state.refresh(before, dt.date(1998, 4, 15), dt.date(1998, 4, 15))
    same(before, state, "revenue", "stores")
    assert state.update(before) == []
    # late rows are found, and only their months are rebuilt
    runs = [(dt.date(1998, a, 1), dt.date(1998, b, 1)) for a, b in ((1, 2), (4, 4))]
    assert state.update(after) == runs
    assert [b[1:] for b in state.tables.batches()[-2:]] == runs
    same(after, state)
    state.tables.compact()
    same(after, state, "revenue", "new_customers")
    assert len(state.tables.live()) == 1


def test_a_month_that_loses_all_rows(spark, tmp_path):
    state = ActivityState(spark, str(tmp_path))
    state.refresh(market(spark, SALES), START, END)
    fewer = market(spark, [r for r in SALES if r["created_at"].month != 3])
    assert state.update(fewer) == [(dt.date(1998, 3, 1), dt.date(1998, 3, 1))]
    same(fewer, state)
    assert state.tables.table("traders", dt.date(1998, 3, 1), dt.date(1998, 3, 1)).count() == 0


def test_a_failed_batch_changes_nothing(spark, tmp_path):
    state = ActivityState(spark, str(tmp_path))
    mk = market(spark, SALES)
    state.refresh(mk, START, END)

    class Broken(Marketplace):
        def table(self, name, *columns, **asked):
            if name == "invoices":
                raise RuntimeError("no invoices")
            return mk.table(name, *columns, **asked)

    with pytest.raises(RuntimeError):
        state.refresh(Broken(spark, {}), START, END)
    # rows of a batch that was never made valid
    tables = state.tables
    orphan = tables.table("orders").limit(3)
    orphan.write.partitionBy("month").parquet(f"{tables.root}/orders/batch=2")
    same(mk, state, "revenue")
    state.refresh(mk, END, END)
    same(mk, state, "revenue")


def test_no_rows(spark, tmp_path):
    mk = market(spark, [])
    state = built_state(mk, str(tmp_path))
    same(mk, state)
    state.refresh(mk, START, END)
    same(mk, state, "stores")


def test_other_months_are_not_read(spark, tmp_path):
    tables = MonthlyTables(spark, str(tmp_path), {"t": "n int"})
    frame = spark.sql("SELECT explode(sequence(DATE'1998-01-01', DATE'1998-12-01', INTERVAL 1 MONTH)) AS month")
    tables.replace({"t": frame.selectExpr("month", "month(month) AS n")}, dt.date(1998, 1, 1), dt.date(1998, 12, 1))
    tables.replace({"t": frame.selectExpr("month", "100 AS n")}, dt.date(1998, 5, 1), dt.date(1998, 6, 1))
    held = tables.table("t", dt.date(1998, 4, 9), dt.date(1998, 7, 9))
    assert sorted(r.n for r in held.collect()) == [4, 7, 100, 100]
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_a_report_from_state_reads_no_sales(spark, tmp_path):
    mk = marketplace_from_orders(spark, "/root/testdata/sf0.001")
    state = built_state(mk, str(tmp_path))
    plan = ops.revenue_report(mk, START, END, state=state)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "orders.parquet" not in plan


def test_bounds_reach_the_scan(spark):
    mk = marketplace_from_orders(spark, "/root/testdata/sf0.001")
    for report in (ops.revenue_report, ops.user_store_report, ops.marketplace_report):
        plan = report(mk, START, END)._jdf.queryExecution().executedPlan().toString()
        assert "ThanOrEqual(o_orderdate" in plan, report
