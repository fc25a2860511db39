"""Sheets on disk, their formats, widths and names."""

import datetime as dt
import os
from decimal import Decimal

from bazaarlens import Marketplace
from bazaarlens.plans.investor import FACTS, store_month_pivot
from bazaarlens.sinks import workbook
from bazaarlens.sources.schema import RELATIONS, schema
from shop import row, rows, shop

RANGE = (dt.date(1998, 1, 1), dt.date(1998, 4, 30))


def small(spark):
    return shop(spark, sales=[{}, {"invoice_id": 2, "buyer_id": 3, "subtotal": "1234.56"}],
                invoice_items=[{}, {"invoice_item_id": "b", "invoice_id": 2}], posts=[{}], drugs=[{}])


def test_report_name():
    assert workbook.report_name("Investor_Report_Monthly", *RANGE) == "Investor_Report_Monthly_Jan98_Apr98"
    assert workbook.report_name("Stores_KPI_Monthly", None, dt.date(2003, 12, 1)) == "Stores_KPI_Monthly_NA_Dec03"


def test_sheets_are_written_in_order(spark, tmp_path):
    sheets = workbook.kpi_sheets(small(spark), *RANGE)
    paths = workbook.write_sheets(sheets, str(tmp_path), workbook.report_name("Stores_KPI_Monthly", *RANGE))
    assert [os.path.basename(p) for p in paths] == ["01_Buyers_KPI", "02_Sellers_KPI"]
    assert "Stores_KPI_Monthly_Jan98_Apr98" in paths[0]
    for path, sheet in zip(paths, sheets.values()):
        assert rows(spark.read.parquet(path)) == rows(sheet)
    assert len(workbook.write_sheets(sheets, str(tmp_path), "text", "csv")) == 2


def test_investor_report_is_one_dataset(spark, tmp_path):
    mk = small(spark)
    path = workbook.write_investor_report(mk, str(tmp_path), *RANGE)
    stored = spark.read.parquet(path)
    assert {r["sheet"] for r in rows(stored)} == {sheet for sheet, _, _ in FACTS.values()}
    sheets = workbook.investor_sheets(mk, *RANGE)
    assert list(sheets) == [sheet for sheet, _, _ in FACTS.values()]
    for fact, (sheet, _, _) in FACTS.items():
        assert rows(sheets[sheet]) == rows(store_month_pivot(mk, fact, *RANGE))


def test_named_formats_take_numeric_text(spark):
    frame = spark.createDataFrame(
        [("1234.5", "x", 5), ("n/a", "y", 1234567), (None, "z", None)],
        "`GMV ($)` string, Month string, `Total Transactions` bigint",
    )
    shown = sorted(rows(workbook.format_named(frame)), key=lambda r: r["Month"])
    assert [r["GMV ($)"] for r in shown] == ["1,234.50", "n/a", None]
    assert [r["Total Transactions"] for r in shown] == ["5", "1,234,567", None]


def test_widths(spark):
    frame = spark.createDataFrame(
        [(1, Decimal("1234567.50"), "ab"), (22, Decimal("3.00"), None)], "id bigint, v decimal(18,2), a_long_name string"
    )
    widths = {r["column_name"]: r["width"] for r in rows(workbook.column_widths(frame, None, 0.5))}
    # 22: two digits and one; 1,234,567: seven digits, two commas, one, and three for the decimals
    assert widths == {"id": 3.5, "v": 13.5, "a_long_name": 11.5}
    named = spark.createDataFrame([("1234.5",), ("text that is long",)], "`GMV ($)` string")
    assert row(workbook.column_widths(named, workbook.KPI_DECIMALS, 2.0))["width"] == 19.0


def test_tables_of_a_catalog(spark, tmp_path):
    for name in RELATIONS:
        small(spark).table(name).createOrReplaceTempView("users_of_auth" if name == "users" else f"shop_{name}")
    named = {n: f"shop_{n}" for n in RELATIONS} | {"users": "users_of_auth"}
    mk = Marketplace.from_catalog(spark, "public", named)
    assert mk.table("sales", "invoice_id").count() == 2
    assert mk.table("users", *schema("users").names).count() == 0
