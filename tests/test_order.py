"""The order of reports that are sorted. Rows come from several partitions, so an unsorted report shows."""

import datetime as dt

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
UP, DOWN = False, True


def month(text):
    for form in ("%Y-%m", "%b %Y"):
        try:
            return dt.datetime.strptime(text, form)
        except ValueError:
            pass
    raise ValueError(text)


STR = [("STR (%)", DOWN), ("Posts Sold", DOWN)]
ORDERS = {
    "r03_new_customers": [("customer_date", UP)],
    "r04_new_signups": [("signup_date", UP)],
    "r18_revenue_mix": [("revenue_mtd", DOWN)],
    "r20_marketplace_report": [("Month", UP)],
    "r21_revenue_report": [("Month", UP)],
    "r22_user_store_report": [("Month", UP)],
    "r23_benchmark_markets": [("STR (%)", DOWN), ("Total Posts", DOWN), ("NDC", UP), ("State", UP)],
    "r24_buyer_state_summary": [("Total Purchases", DOWN), ("Buyer State", UP)],
    "r25_buyer_stores": [("Total Savings", DOWN)],
    "r26_drug_analysis": [*STR, ("NDC", UP)],
    "r27_seller_state_summary": [("Total Sales", DOWN), ("Seller State", UP)],
    "r28_seller_stores": [*STR, ("Seller ID", UP)],
    "r29_state_analysis": [*STR, ("Drug Category", UP), ("Seller State", UP), ("Buyer State", UP)],
    "r30_kpi_buyers": [("Month", UP)],
    "r31_kpi_sellers": [("Month", UP)],
    "r32_ir_months": [("sale_month", UP)],
    **{f"r{n}": [("store_id", UP), ("sale_month", UP)] for n in range(33, 39)},
    "t02_pivot_buyer_spend": [("Store ID", UP)],
}


def keyed(row, order):
    """Nulls come first in descending columns and last in ascending ones, unless the report says otherwise."""
    out = []
    for name, down in order:
        value = row[name]
        if name == "Month":
            value = month(value)
        if value is None:
            out.append((0 if down else 2, 0))
        elif down:
            out.append((1, -value))
        else:
            out.append((1, value))
    return out


@pytest.mark.parametrize("name", ORDERS)
def test_order(spark, name):
    full = next(n for n in entry.queries() if n.startswith(name))
    frame = entry.queries()[full](spark, FOLDER)
    names = {c.lower(): c for c in frame.columns}
    order = [(names[c.lower()], d) for c, d in ORDERS[name] if c.lower() in names]
    assert order
    rows = [keyed(r, order) for r in frame.collect()]
    assert len(rows) > 1 and rows == sorted(rows)
