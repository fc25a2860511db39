"""Report sets: named sheets, display formats, column widths and dated names.

A sheet is one dataset; the workbook file of a desktop tool is not written.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.functions.formats import grouped, grouped_by_value, is_whole
from bazaarlens.operators.pivot import MONTH_NAMES
from bazaarlens.plans.investor import FACTS, all_sheets
from bazaarlens.plans.kpi import buyers_kpi, sellers_kpi
from bazaarlens.sinks.published import ReportSet, Sheet
from bazaarlens.sources.marketplace import Marketplace

# fixed values: decimals shown per named column
KPI_DECIMALS = {
    "GMV ($)": 2,
    "GMV from New ($)": 2,
    "GMV from Repeat ($)": 2,
    "Avg Order Value ($)": 2,
    "Net Revenue ($)": 2,
    "Total Savings ($)": 2,
    "Total Transactions": 0,
    "Units Sold": 0,
    "Units Bought": 0,
    "Active Sellers": 0,
    "Active Buyers": 0,
    "New Sellers": 0,
    "New Buyers": 0,
    "Repeat Sellers": 0,
    "Repeat Buyers": 0,
}
KPI_PAD, INVESTOR_PAD = 2.0, 0.5


def kpi_sheets(mk: Marketplace, start: dt.date, end: dt.date) -> dict[str, DataFrame]:
    return {"Buyers KPI": buyers_kpi(mk, start, end), "Sellers KPI": sellers_kpi(mk, start, end)}


def investor_sheets(mk: Marketplace, start: dt.date, end: dt.date) -> dict[str, DataFrame]:
    wide = all_sheets(mk, start, end)
    return {
        sheet: wide.where(F.col("sheet") == sheet).drop("position", "sheet") for sheet, _, _ in FACTS.values()
    }


def report_name(stem: str, start: dt.date | None, end: dt.date | None) -> str:
    """Stem_Jan96_Dec96; a missing date shows as NA."""
    def short(day: dt.date | None) -> str:
        return f"{MONTH_NAMES[day.month - 1]}{day.year % 100:02d}" if day else "NA"

    return f"{stem}_{short(start)}_{short(end)}"


def report_name_column(stem: str, start: Column, end: Column) -> Column:
    """The same name from date columns, for a report on a range found in the data."""
    short = [F.coalesce(F.date_format(day, "MMMyy"), F.lit("NA")) for day in (start, end)]
    return F.concat_ws("_", F.lit(stem), *short)


def write_sheets(
    sheets: Mapping[str, DataFrame], folder: str, name: str, file_format: str = "parquet", mode: str = "errorifexists"
) -> list[str]:
    """Write every sheet under folder/name/<position>_<sheet>, in order; returns the paths.

    Parquet keeps the sheet's column names as they are.
    """
    paths = []
    for position, (sheet, frame) in enumerate(sheets.items(), start=1):
        path = f"{folder}/{name}/{position:02d}_{sheet.replace(' ', '_')}"
        writer = frame.write.mode(mode).format(file_format)
        (writer.option("header", True) if file_format == "csv" else writer).save(path)
        paths.append(path)
    return paths


def write_investor_report(
    mk: Marketplace, folder: str, start: dt.date, end: dt.date, file_format: str = "parquet", mode: str = "errorifexists"
) -> str:
    """All six sheets in one job and one pass over the sales, as folder/name/position=1/sheet=..."""
    path = f"{folder}/{report_name('Investor_Report_Monthly', start, end)}"
    all_sheets(mk, start, end).write.mode(mode).format(file_format).partitionBy("position", "sheet").save(path)
    return path


def publish_kpi_report(mk: Marketplace, folder: str, start: dt.date, end: dt.date) -> ReportSet:
    """Both key figure sheets as one edition; their order is the months'."""
    months = F.to_date(F.col("Month"), "MMM yyyy")
    published = ReportSet(mk.spark, f"{folder}/{report_name('Stores_KPI_Monthly', start, end)}")
    published.publish({name: Sheet(frame, [months]) for name, frame in kpi_sheets(mk, start, end).items()})
    return published


def publish_investor_report(mk: Marketplace, folder: str, start: dt.date, end: dt.date) -> ReportSet:
    """The six sheets as one edition, in one pass over the sales; their order is the stores'."""
    published = ReportSet(mk.spark, f"{folder}/{report_name('Investor_Report_Monthly', start, end)}")
    names = [sheet for sheet, _, _ in FACTS.values()]
    rows = all_sheets(mk, start, end).drop("position")
    published.publish_together(rows, names, "sheet", [F.asc_nulls_last("Store ID")])
    return published


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _as_number(value: Column, kind: T.DataType) -> Column:
    """A number, or the number a text holds, else NULL."""
    return value if _is_number(kind) else F.trim(value.cast("string")).try_cast("decimal(38,10)")


def format_named(sheet: DataFrame, decimals: Mapping[str, int] = KPI_DECIMALS) -> DataFrame:
    """Show the named columns with grouped digits; text that is no number, and other columns, stay."""
    cells = []
    for field in sheet.schema.fields:
        cell = F.col(f"`{field.name}`")
        if field.name in decimals:
            number = _as_number(cell, field.dataType)
            cell = F.coalesce(grouped(number, decimals[field.name]), cell.cast("string"))
        cells.append(cell.alias(field.name))
    return sheet.select(*cells)


def format_by_value(sheet: DataFrame) -> DataFrame:
    """Show every number: whole ones without decimals, others with two."""
    return sheet.select(
        *[
            (grouped_by_value(F.col(f"`{f.name}`")) if _is_number(f.dataType) else F.col(f"`{f.name}`")).alias(f.name)
            for f in sheet.schema.fields
        ]
    )


def _number_length(value: Column, decimals: Column) -> Column:
    digits = F.length(F.floor(F.abs(value)).cast("decimal(38,0)").cast("string"))
    return digits + F.floor((digits - 1) / 3).cast("int") + 1 + F.when(decimals, 3).otherwise(0)


def column_widths(sheet: DataFrame, decimals: Mapping[str, int] | None, pad: float) -> DataFrame:
    """(position, column_name, width): the longest of header and cells, plus the pad.

    With `decimals` the named columns decide about the two decimals, else each value does. All
    columns come from one aggregate over the sheet.
    """
    longest = []
    for field in sheet.schema.fields:
        cell = F.col(f"`{field.name}`")
        number = _as_number(cell, field.dataType)
        if decimals is None:
            length = _number_length(number, ~is_whole(number))
        else:
            length = _number_length(number, F.lit(decimals.get(field.name) == 2))
        if not _is_number(field.dataType):
            text = F.length(cell.cast("string"))
            length = F.coalesce(length, text) if field.name in (decimals or {}) else text
        longest.append(F.max(length).cast("int").alias(field.name))
    widths = sheet.agg(*longest)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                (F.greatest(F.col(f"`{f.name}`"), F.lit(len(f.name))) + F.lit(pad)).alias("width"),
            )
            for i, f in enumerate(sheet.schema.fields, start=1)
        ]
    )
    return widths.select(F.explode(rows).alias("w")).select("w.*")
