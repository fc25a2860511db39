"""Hand-computed cases on tiny marketplaces."""

import datetime as dt

from pyspark.sql import functions as F

from bazaarlens.plans import churn, investor, kpi, ops, overview, pieces, revenue, sell_through, signups, snapshot
from shop import row, rows, shop

AS_OF = dt.date(1998, 3, 31)
YEAR = (dt.date(1998, 1, 1), dt.date(1998, 12, 31))


def at(month, day, hour=0, year=1998):
    return dt.datetime(year, month, day, hour)


def test_empty_month(spark):
    mk = shop(spark)
    assert row(revenue.completed_gmv(mk, AS_OF)) == {"month_name": "March    ", "gmv_mtd": None}
    assert row(snapshot.mtd_active_stores(mk, AS_OF)) == {
        "active_stores_now": 0, "active_stores_last_month": 0, "current_vs_last_month_pct": 0.0,
    }
    assert set(row(churn.churn_rates(mk, AS_OF, 30)).values()) == {None}
    assert row(revenue.gmv_retention_mtd(mk, AS_OF)) == {"gmv_retention_pct_current_month": None}
    assert [r["revenue_mtd"] for r in rows(revenue.revenue_mix(mk, AS_OF))] == [0.0, 0.0]
    assert row(overview.admin_metrics(mk, AS_OF))["total_sales"] == 0.0


def test_first_day_has_an_empty_previous_period(spark):
    mk = shop(spark, sales=[{"seller_signed_on": at(2, 1)}, {"invoice_id": 2, "seller_signed_on": at(3, 1)}])
    found = row(snapshot.mtd_total_invoices(mk, dt.date(1998, 3, 1)))
    assert (found["mtd_completed_invoices"], found["last_month_completed_invoices"]) == (1, 0)


def test_day_31_counts_early_march_twice(spark):
    mk = shop(spark, sales=[{"seller_signed_on": at(3, 2)}])
    found = row(snapshot.mtd_total_invoices(mk, AS_OF))
    assert (found["mtd_completed_invoices"], found["last_month_completed_invoices"]) == (1, 1)


def test_sale_later_today(spark):
    mk = shop(spark, sales=[{"seller_signed_on": at(3, 31, 10)}])
    assert row(snapshot.mtd_total_invoices(mk, AS_OF))["mtd_completed_invoices"] == 0
    assert row(snapshot.mtd_aov(mk, AS_OF))["aov_current"] == 100.0


def test_item_fan_out(spark):
    mk = shop(
        spark,
        sales=[{}], posts=[{"post_id": i} for i in (1, 2, 3)],
        invoice_items=[{"invoice_item_id": str(i), "post_id": i} for i in (1, 2, 3)]
        + [{"invoice_item_id": "x", "status": "REMOVED"}],
        stores=[{}, {"store_id": 2}], addresses=[{}], drugs=[{}],
    )
    assert row(sell_through.buyer_state_summary(mk, *YEAR)) == {
        "Buyer State": "CA", "Total Purchases": 3, "Unique Buyer Stores": 1, "Total Purchase Revenue": 300.0,
    }
    assert row(investor.store_month_fact(mk, "buyer_spend", *YEAR))["value"] == 100.0


def test_post_sold_twice(spark):
    mk = shop(
        spark,
        sales=[{}, {"invoice_id": 2, "buyer_id": 3}], posts=[{}, {"post_id": 2}],
        invoice_items=[{}, {"invoice_item_id": "b", "invoice_id": 2}],
        stores=[{"store_id": i} for i in (1, 2, 3)], addresses=[{}], drugs=[{}],
    )
    market = row(sell_through.benchmark_markets(mk, *YEAR, min_posts=1, min_rate=0.1))
    # Two lines of the sold post and one of the unsold post.
    assert (market["Total Posts"], market["Total Sold"], market["STR (%)"]) == (3, 1, 33.33)
    assert (market["Buyer Stores (Same State)"], market["Seller:Buyer Ratio"]) == (2, 0.5)
    product = row(sell_through.drug_analysis(mk, *YEAR, 1))
    assert (product["Posts Made"], product["Posts Sold"], product["STR (%)"]) == (3, 2, 66.67)
    by_state = rows(sell_through.state_analysis(mk, *YEAR, 0))
    assert {(r["Buyer State"], r["Posts Made"], r["Posts Sold"]) for r in by_state} == {("CA", 2, 2), (None, 1, 0)}


def test_unknown_fee(spark):
    mk = shop(spark, sales=[{"fee_percent": None}, {"invoice_id": 2, "subtotal": 50}])
    assert row(revenue.completed_revenue(mk, AS_OF))["total_platform_revenue_mtd"] == 2.5
    march = rows(ops.revenue_report(mk, dt.date(1998, 3, 1), AS_OF))[0]
    assert (march["GMV ($)"], march["Net Revenue ($)"], march["Weighted Take Rate (%)"]) == ("150.00", "2.50", "1.67")


def test_partial_quantities(spark):
    mk = shop(
        spark, sales=[{}, {"invoice_id": 2}], drugs=[{}], stores=[{}], addresses=[{}],
        posts=[{"partial_quantity": 0}, {"post_id": 2, "price": None}],
        invoice_items=[{}, {"invoice_item_id": "b", "invoice_id": 2, "post_id": 2}],
    )
    # A quantity of 0 is no partial sale here; the line without a price is dropped.
    buyer = row(sell_through.buyer_stores(mk, *YEAR, 1))
    assert (buyer["Posts Bought"], buyer["Total Savings"], buyer["Avg Monthly Savings"]) == (1, 30.0, None)
    # Here it is one (-20), and the missing price counts as 0 (+50).
    month = row(kpi.buyers_kpi(mk, *YEAR))
    assert (month["Units Bought"], month["Total Savings ($)"]) == (2, 30.0)
    assert rows(pieces.strict_savings(mk))[0]["savings"] == 30.0


def test_retention_gap(spark):
    mk = shop(spark, sales=[
        {"invoice_id": 1, "seller_signed_on": at(1, 5)},
        {"invoice_id": 2, "seller_signed_on": at(3, 5)},
        {"invoice_id": 3, "seller_id": 9, "seller_signed_on": at(2, 5), "subtotal": 40},
        {"invoice_id": 4, "seller_id": 9, "seller_signed_on": at(3, 5), "subtotal": 10},
    ])
    report = {r["Month"]: r["GMV Retention (%)"] for r in rows(ops.revenue_report(mk, dt.date(1998, 1, 1), AS_OF))}
    assert report == {"1998-01": ".00", "1998-02": ".00", "1998-03": "25.00"}


def test_identical_sale_rows_count_once_in_money(spark):
    mk = shop(spark, sales=[{}, {}])
    march = rows(ops.revenue_report(mk, dt.date(1998, 3, 1), AS_OF))[0]
    assert (march["GMV ($)"], march["Total Invoices"], march["Avg Order Value ($)"]) == ("100.00", 2, "100.00")


def test_new_in_range_against_new_ever(spark):
    mk = shop(spark, invoice_items=[{}, {"invoice_item_id": "b", "invoice_id": 2}], sales=[
        {"seller_signed_on": at(2, 5, year=1997)}, {"invoice_id": 2, "seller_signed_on": at(2, 5)},
    ])
    assert row(kpi.sellers_kpi(mk, *YEAR))["New Sellers"] == 1.0
    february = rows(ops.revenue_report(mk, dt.date(1998, 2, 1), dt.date(1998, 2, 28)))[0]
    assert february["Revenue from New Sellers ($)"] == ".00"
    assert february["Revenue from Existing Sellers ($)"] == "5.00"


def test_rounding_per_invoice_and_of_the_sum(spark):
    # 0.10 x 5 % = 0.005 three times.
    mk = shop(
        spark, sales=[{"invoice_id": i, "subtotal": "0.10"} for i in (1, 2, 3)],
        invoice_items=[{"invoice_item_id": str(i), "invoice_id": i} for i in (1, 2, 3)],
    )
    assert row(investor.store_month_fact(mk, "rev_by_buyer", *YEAR))["value"] == 0.03
    assert row(revenue.completed_revenue(mk, AS_OF))["total_platform_revenue_mtd"] == 0.02


def test_store_in_both_roles_is_active_once(spark):
    mk = shop(spark, sales=[{}, {"invoice_id": 2, "buyer_id": 2, "seller_id": 1}])
    march = rows(ops.user_store_report(mk, dt.date(1998, 3, 1), AS_OF))[0]
    assert (march["Active Stores"], march["Active Buyers"], march["Active Sellers"]) == (2, 2, 2)
    assert march["New Customers"] == 2


def test_single_post_has_no_monthly_revenue(spark):
    mk = shop(spark, sales=[{}], posts=[{}], invoice_items=[{}], drugs=[{}], stores=[{"store_id": 2}], addresses=[{}])
    seller = row(sell_through.seller_stores(mk, *YEAR, 1))
    assert seller["Avg Monthly Revenue"] is None
    assert (seller["Total Revenue"], seller["Avg Days to Sale"]) == (100.0, 9.0)


def test_month_outside_the_pivot(spark):
    long = investor.store_month_fact(shop(spark, sales=[{}], invoice_items=[{}]), "buyer_spend", *YEAR)
    wide = row(investor.pivot_months(long, dt.date(1997, 1, 1), dt.date(1997, 2, 1)))
    assert wide == {"Store ID": 1, "Jan 1997": 0.0, "Feb 1997": 0.0, "Total": 0.0}


def test_missing_total_sorts_first(spark):
    mk = shop(
        spark, sales=[{}, {"invoice_id": 2, "buyer_id": 3}], stores=[{}, {"store_id": 3, "address_id": None}],
        posts=[{}, {"post_id": 2, "ndc": 2}], drugs=[{}, {"ndc_upc_hri": 2, "package_price": None}],
        invoice_items=[{}, {"invoice_item_id": "b", "invoice_id": 2, "post_id": 2}], addresses=[{}],
    )
    found = rows(sell_through.buyer_stores(mk, *YEAR, 1))
    assert [(r["Buyer ID"], r["Total Savings"], r["State"]) for r in found] == [(3, None, None), (1, 30.0, "CA")]


def test_last_day_of_a_range_is_cut_or_whole(spark):
    end = dt.date(1998, 3, 10)
    mk = shop(spark, sales=[{}], invoice_items=[{}], stores=[{}])
    assert rows(investor.store_month_fact(mk, "buyer_txn", dt.date(1998, 1, 1), end)) == []
    assert rows(signups.new_signups(mk, end, end)) == [{"signup_date": end, "new_store_signups": 1}]


def test_churn_rates(spark):
    # Window of 30 days up to 31 March: current from 2 March, past from 31 January.
    old, new = at(2, 10), at(3, 10)
    mk = shop(
        spark,
        stores=[{"store_id": i} for i in range(1, 7)],
        sales=[
            {"invoice_id": 1, "buyer_id": 1, "seller_id": 2, "seller_signed_on": old},
            {"invoice_id": 2, "buyer_id": 1, "seller_id": 3, "seller_signed_on": old},
            {"invoice_id": 3, "buyer_id": 4, "seller_id": 5, "seller_signed_on": old},
            {"invoice_id": 4, "buyer_id": 4, "seller_id": 5, "seller_signed_on": new},
            {"invoice_id": 4, "buyer_id": 4, "seller_id": 5, "seller_signed_on": new},
            {"invoice_id": 5, "buyer_id": 99, "seller_id": 98, "seller_signed_on": old},
            {"invoice_id": 6, "buyer_id": 1, "seller_id": 2, "seller_signed_on": new, "invoice_status": "PENDING"},
        ],
        posts=[{"post_id": 1, "seller_id": 2, "created_at": new}, {"post_id": 2, "seller_id": 6, "created_at": old}],
    )
    found = row(churn.churn_rates(mk, AS_OF, 30))
    assert found == {
        # sellers with a past sale: 2 (posts now), 3 (gone), 5 (sells now)
        "Seller Churn (%)": 33.33,
        # buyers with a past purchase: 1 (gone), 4 (buys now)
        "Buyer Churn (%)": 50.0,
        # past activity: 1, 2, 3, 4, 5, 6; silent now: 1, 3, 6
        "Overall Churn (%)": 50.0,
        # exactly one sale or purchase now, counted by invoice: 4, 5
        "One-timer (%)": 33.33,
        "One-time Buyer (%)": 50.0,
        # past sellers or posters: 2, 3, 5, 6; one sale now: 5
        "One-time Seller (%)": 25.0,
    }


def test_admin_metrics_users_and_goal_zone(spark):
    mk = shop(
        spark,
        users=[{}, {"id": 2, "email": "x@STAFF.example"}, {"id": 3, "email": None}, {"id": 4, "last_sign_in_at": None},
               {"id": 5, "last_sign_in_at": at(2, 28)}],
        monthly_sales_goal=[{}, {"month_year": dt.date(1998, 4, 1), "sales_goal": 20}],
    )
    assert row(overview.admin_metrics(mk, AS_OF))["active_users"] == 1
    assert row(overview.monthly_goal(mk, dt.datetime(1998, 4, 1, 7, 59)))["sales_goal"] == 10.0
    assert row(overview.monthly_goal(mk, dt.datetime(1998, 4, 1, 8, 0)))["sales_goal"] == 20.0


def test_onboarding_needs_a_started_account_in_the_same_month(spark):
    mk = shop(
        spark,
        stores=[{"store_id": i, "funding_id": i} for i in (1, 2, 3, 4)],
        funding_accounts=[{"funding_id": 1}, {"funding_id": 2, "funding_status": "NOT_STARTED"},
                          {"funding_id": 3, "created_at": at(4, 1)}],
        sales=[{"buyer_id": 1, "seller_id": 2}],
    )
    march = rows(ops.user_store_report(mk, dt.date(1998, 3, 1), AS_OF))[0]
    assert (march["New Sign-ups"], march["New Onboards"], march["New Onboards Percent"]) == (4, 1, 25.0)
    assert (march["Activations"], march["Activations Percent"]) == (2, 50.0)


def test_calendar_without_rows(spark):
    months = rows(investor.months(shop(spark), dt.date(1998, 1, 31), dt.date(1998, 3, 1)))
    assert [m["pretty"] for m in months] == ["Jan 1998", "Feb 1998", "Mar 1998"]
    assert rows(investor.months(shop(spark), dt.date(1998, 4, 1), dt.date(1998, 3, 1))) == []
    assert investor.months_of_sales(shop(spark)).count() == 0
    frame = ops.marketplace_report(shop(spark), dt.date(1998, 1, 1), dt.date(1998, 2, 1))
    assert frame.agg(F.sum("New Posts"), F.count("*")).first() == (0, 2)
