"""Every report and operator under its query name, with one set of standard arguments."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from bazaarlens.plans import (
    by_day,
    churn,
    distinct_spans,
    from_state,
    investor,
    kpi,
    ops,
    overview,
    pieces,
    revenue,
    sell_through,
    signups,
    snapshot,
)
from bazaarlens.sinks import workbook
from bazaarlens.sources.marketplace import Marketplace


@dataclass(frozen=True)
class ReportArgs:
    """as_of lies on a 31st, where the previous period reaches into the current month. The range
    covers all data; sub_start and sub_end serve the operators that are about a part of it."""

    as_of: dt.date = dt.date(1998, 3, 31)
    start: dt.date = dt.date(1995, 1, 1)
    end: dt.date = dt.date(2001, 12, 31)
    now: dt.datetime = dt.datetime(1998, 4, 1, 3, 0)
    churn_days: int = 30
    min_sales: int = 5
    min_posts: int = 3
    min_rate: float = 0.5
    sub_start: dt.date = dt.date(1996, 1, 1)
    sub_end: dt.date = dt.date(1996, 12, 31)
    days_start: dt.date = dt.date(1998, 2, 20)
    days_end: dt.date = dt.date(1998, 4, 2)
    zone: str = "America/Los_Angeles"


Plan = Callable[[Marketplace, ReportArgs], DataFrame]


def _day(plan: Callable[[Marketplace, dt.date], DataFrame]) -> Plan:
    return lambda mk, a: plan(mk, a.as_of)


def _range(plan: Callable[[Marketplace, dt.date, dt.date], DataFrame]) -> Plan:
    return lambda mk, a: plan(mk, a.start, a.end)


def _days(plan: Callable[[Marketplace, dt.date, dt.date], DataFrame]) -> Plan:
    return lambda mk, a: plan(mk, a.days_start, a.days_end)


def _sales_range(plan: Callable[[Marketplace, dt.date, dt.date, int], DataFrame]) -> Plan:
    return lambda mk, a: plan(mk, a.start, a.end, a.min_sales)


def _whole(plan: Callable[[Marketplace], DataFrame]) -> Plan:
    return lambda mk, a: plan(mk)


def _fact(name: str) -> Plan:
    return lambda mk, a: investor.store_month_fact(mk, name, a.start, a.end)


def _pivot(name: str) -> Plan:
    return lambda mk, a: investor.store_month_pivot(mk, name, a.start, a.end)


PLANS: dict[str, Plan] = {
    "r01_admin_metrics": _day(overview.admin_metrics),
    "r02_monthly_goal": lambda mk, a: overview.monthly_goal(mk, a.now),
    "r03_new_customers": _range(signups.new_customers),
    "r04_new_signups": _range(signups.new_signups),
    "r05_churn": lambda mk, a: churn.churn_rates(mk, a.as_of, a.churn_days),
    "r06_mtd_activation": _day(snapshot.mtd_activation),
    "r07_mtd_active_posts": _day(snapshot.mtd_active_posts),
    "r08_mtd_active_stores": _day(snapshot.mtd_active_stores),
    "r09_mtd_aov": _day(snapshot.mtd_aov),
    "r10_mtd_avg_days": _day(snapshot.mtd_avg_days),
    "r11_mtd_items_sold": _day(snapshot.mtd_items_sold),
    "r12_mtd_total_invoices": _day(snapshot.mtd_total_invoices),
    "r13_completed_gmv": _day(revenue.completed_gmv),
    "r14_completed_revenue": _day(revenue.completed_revenue),
    "r15_pending_gmv": _day(revenue.pending_gmv),
    "r16_pending_revenue": _day(revenue.pending_revenue),
    "r17_weighted_take_rate": _day(revenue.weighted_take_rate),
    "r18_revenue_mix": _day(revenue.revenue_mix),
    "r19_gmv_retention_mtd": _day(revenue.gmv_retention_mtd),
    "r20_marketplace_report": _range(ops.marketplace_report),
    "r21_revenue_report": _range(ops.revenue_report),
    "r22_user_store_report": _range(ops.user_store_report),
    "r23_benchmark_markets": lambda mk, a: sell_through.benchmark_markets(
        mk, a.start, a.end, a.min_posts, a.min_rate
    ),
    "r24_buyer_state_summary": _range(sell_through.buyer_state_summary),
    "r25_buyer_stores": _sales_range(sell_through.buyer_stores),
    "r26_drug_analysis": _sales_range(sell_through.drug_analysis),
    "r27_seller_state_summary": _range(sell_through.seller_state_summary),
    "r28_seller_stores": _sales_range(sell_through.seller_stores),
    "r29_state_analysis": _sales_range(sell_through.state_analysis),
    "r30_kpi_buyers": _range(kpi.buyers_kpi),
    "r31_kpi_sellers": _range(kpi.sellers_kpi),
    # The plain calendar reads no table; registered is the one that covers the sales.
    "r32_ir_months": _whole(investor.months_of_sales),
    "r33_ir_buyer_spend": _fact("buyer_spend"),
    "r34_ir_seller_earnings": _fact("seller_earnings"),
    "r35_ir_buyer_txn": _fact("buyer_txn"),
    "r36_ir_seller_txn": _fact("seller_txn"),
    "r37_ir_rev_by_buyer": _fact("rev_by_buyer"),
    "r38_ir_rev_by_seller": _fact("rev_by_seller"),
    # With months and days of a zone.
    "r01_admin_metrics_local": lambda mk, a: overview.admin_metrics(mk, a.as_of, borders=a.zone),
    "r08_mtd_active_stores_local": lambda mk, a: snapshot.mtd_active_stores(mk, a.as_of, borders=a.zone),
    "p01_contract": _whole(pieces.contract_violations),
    "p60_share_of_month": _whole(pieces.shares_of_month),
    "p62_ranked_sellers": _whole(pieces.ranked_sellers),
    # The reports of all days of a range.
    "r05_churn_by_day": lambda mk, a: by_day.churn(mk, a.days_start, a.days_end, a.churn_days),
    "r08_active_stores_by_day": _days(by_day.active_stores),
    "r09_aov_by_day": _days(by_day.order_value),
    "r10_avg_days_by_day": _days(by_day.average_days),
    "r11_items_sold_by_day": _days(by_day.items_sold),
    "r12_total_invoices_by_day": _days(by_day.total_invoices),
    # Distinct counts of any months, from monthly bitmaps.
    "p47_distinct_spans": lambda mk, a: distinct_spans.stores_and_invoices(mk, a.sub_start, a.sub_end),
    "p48_buyers_by_state_spans": lambda mk, a: distinct_spans.buyers_by_state(mk, a.sub_start, a.sub_end),
    # From a state kept by month.
    "r03_new_customers_kept": _range(from_state.from_state(signups.new_customers)),
    "r06_mtd_activation_kept": _day(from_state.from_state(snapshot.mtd_activation)),
    "r18_revenue_mix_kept": _day(from_state.from_state(revenue.revenue_mix)),
    "r21_revenue_report_kept": _range(from_state.from_state(ops.revenue_report)),
    "r22_user_store_report_kept": _range(from_state.from_state(ops.user_store_report)),
    "t01_month_labels": lambda mk, a: pieces.labelled_spend(mk, a.start, a.end, a.sub_start, a.sub_end),
    **{f"t02_pivot_{name}": _pivot(name) for name in investor.FACTS},
    "t05_report_set": _range(pieces.report_set),
    "t05_investor_rows": _range(investor.all_facts),
    "t05_kpi_pair": _range(pieces.kpi_pair),
    "t06_kpi_buyers_formatted": lambda mk, a: workbook.format_named(kpi.buyers_kpi(mk, a.start, a.end)),
    "t06_kpi_sellers_formatted": lambda mk, a: workbook.format_named(kpi.sellers_kpi(mk, a.start, a.end)),
    "t07_investor_formatted": lambda mk, a: workbook.format_by_value(_pivot("buyer_spend")(mk, a)),
    "t07_investor_counts_formatted": lambda mk, a: workbook.format_by_value(_pivot("seller_txn")(mk, a)),
    **{
        f"t07_{name}_formatted": lambda mk, a, name=name: workbook.format_by_value(_pivot(name)(mk, a))
        for name in investor.FACTS
        if name not in ("buyer_spend", "seller_txn")
    },
    "t08_kpi_sellers_widths": lambda mk, a: workbook.column_widths(
        kpi.sellers_kpi(mk, a.start, a.end), workbook.KPI_DECIMALS, workbook.KPI_PAD
    ),
    **{
        f"t08_{name}_widths": lambda mk, a, name=name: workbook.column_widths(
            _pivot(name)(mk, a), None, workbook.INVESTOR_PAD
        )
        for name in investor.FACTS
        if name != "buyer_spend"
    },
    "t08_kpi_widths": lambda mk, a: workbook.column_widths(
        kpi.buyers_kpi(mk, a.start, a.end), workbook.KPI_DECIMALS, workbook.KPI_PAD
    ),
    "t08_investor_widths": lambda mk, a: workbook.column_widths(
        _pivot("buyer_spend")(mk, a), None, workbook.INVESTOR_PAD
    ),
    "t09_report_name": _whole(pieces.report_name_of_sales),
    "m01_mtd_to_midnight": _day(pieces.mtd_to_midnight_totals),
    "m02_mtd_full_day": _day(pieces.mtd_full_day_totals),
    "m03_calendar_month": _day(pieces.calendar_month_totals),
    "m04_trailing_pair": lambda mk, a: pieces.trailing_totals(mk, a.as_of, a.churn_days),
    "m05_distinct_in_periods": _day(pieces.active_stores_full_day),
    "m06_store_activity": _whole(pieces.store_activity),
    "m07_first_activity": _whole(pieces.seller_first_sale),
    "m08_first_activity_in_range": lambda mk, a: pieces.buyer_first_in_range(mk, a.sub_start, a.sub_end),
    "m09_split_new_existing": _whole(pieces.new_and_existing_gmv),
    "m10_gmv_retention": _whole(pieces.monthly_retention),
    "m11_cohort_activation": _whole(pieces.cohort_activation),
    "m12_onboarding": _whole(pieces.onboarding),
    "m13_churn_flags": lambda mk, a: churn.store_churn_flags(mk, a.as_of, a.churn_days),
    "m14_sold_items": _whole(pieces.sold_per_post),
    "m15_sell_through": _range(pieces.seller_sell_through),
    "m16_savings_strict": _whole(pieces.strict_savings),
    "m17_savings_lenient": _whole(pieces.lenient_savings),
    "m18_take_rate": _whole(pieces.monthly_take_rate),
    "m19_avg_order_value": _whole(pieces.monthly_order_value),
    "m20_days_to_sale": _whole(pieces.product_days_to_sale),
    "m21_monthly_rate": _whole(pieces.buyer_monthly_rate),
    "m22_month_spine": _whole(pieces.posts_by_month),
    "m23_spine_fill": _range(pieces.completed_by_month),
}
