"""What Spark makes of the reports: scans, pushed filters, reuse and joins."""

import re

import pytest

from bazaarlens import Marketplace
from bazaarlens.plans.catalog import PLANS, ReportArgs
from bazaarlens.session import RUNTIME_SETTINGS, tune
from bazaarlens.sources.order_tables import marketplace_from_orders
from shop import shop

ARGS = ReportArgs()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The relations as Parquet, so that plans show real scans."""
    root = str(tmp_path_factory.mktemp("marketplace"))
    one = {n: [{}] for n in ("sales", "invoices", "invoice_items", "posts", "drugs", "stores", "addresses",
                             "funding_accounts", "carts", "users", "monthly_sales_goal")}
    made = shop(spark, **one)
    for name in one:
        made.table(name).write.parquet(f"{root}/{name}")
    return Marketplace.from_parquet(spark, root)


def plan(frame, run=False):
    if run:
        frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def scans(text, relation):
    return [line for line in text.splitlines() if "FileScan" in line and line.rstrip().find(f"/{relation}]") > 0]


@pytest.mark.parametrize(
    "name", ["r08_mtd_active_stores", "r09_mtd_aov", "r11_mtd_items_sold", "r12_mtd_total_invoices",
             "r05_churn", "r19_gmv_retention_mtd", "r22_user_store_report", "r30_kpi_buyers", "r31_kpi_sellers",
             "r33_ir_buyer_spend", "t02_pivot_buyer_spend", "t05_report_set"],
)
def test_sales_are_scanned_once_with_a_range(spark, stored, name):
    text = PLANS[name](stored, ARGS)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    parts = [p for p in text.split("\n\n") if "Scan parquet" in p and re.search(r"/sales\]", p)]
    assert len(parts) == 1
    pushed = next(line for line in parts[0].splitlines() if line.startswith("PushedFilters"))
    assert "seller_signed_on" in pushed and "invoice_status" in pushed


def test_revenue_report_reads_and_shuffles_the_sales_once(stored):
    text = plan(PLANS["r21_revenue_report"](stored, ARGS), run=True)
    assert text.count("FileScan parquet") == 1
    assert "ReusedExchange" in text


@pytest.mark.parametrize("name", [n for n in PLANS if n[0] in "rtm"])
def test_no_product_of_tables(stored, name):
    text = plan(PLANS[name](stored, ARGS))
    assert "CartesianProduct" not in text
    # The nested loops left join one-row totals.
    if "BroadcastNestedLoopJoin" in text:
        assert name.removesuffix("_kept").removesuffix("_local") in ("r01_admin_metrics", "r06_mtd_activation", "r18_revenue_mix")


@pytest.mark.parametrize("name", [n for n in PLANS if n[0] in "rtm"])
def test_only_small_windows_and_no_python(stored, name):
    text = plan(PLANS[name](stored, ARGS))
    assert "Python" not in text and "Pandas" not in text
    for line in text.splitlines():
        if "Window [" in line:
            # Every window has a key, and runs over rows that were grouped by it before.
            assert re.search(r"\], \[\w+#\d+L?(, \w+#\d+L?)*\]", line), line


def test_pivot_runs_no_job_for_its_labels(spark, stored):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    PLANS["t02_pivot_buyer_spend"](stored, ARGS)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == len(before)


def test_tune_sets_the_runtime_settings(spark):
    tune(spark)
    assert {k: spark.conf.get(k) for k in RUNTIME_SETTINGS} == RUNTIME_SETTINGS


@pytest.mark.parametrize("name", ["t06_kpi_buyers_formatted", "r31_kpi_sellers"])
def test_key_figures_group_no_scanned_lines(spark, name):
    """A scan's task is as large as the file's row groups: what it groups before a shuffle, it holds."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = plan(PLANS[name](marketplace_from_orders(tune(spark), "/root/testdata/sf0.001"), ARGS))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    path, seen = [], 0
    for line in text.splitlines():
        if not (found := re.search(r"[A-Za-z]", line)):
            continue
        path = [(at, node) for at, node in path if at < found.start()] + [(found.start(), line)]
        if "FileScan" in line and "l_suppkey" in line:
            seen += 1
            above = [node for _, node in path]
            last = max(i for i, node in enumerate(above) if "Exchange" in node)
            assert not any("Aggregate" in node for node in above[last:]), text
    assert seen >= 2
