"""Ratios, calendar helpers and text forms on given values."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bazaarlens.functions import dates, formats, ratios
from bazaarlens.operators import periods
from bazaarlens.operators.pivot import month_label


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def dec(text):
    return F.lit(Decimal(text))


@pytest.mark.parametrize(
    ("number", "text"),
    [("0", ".00"), ("0.05", ".05"), ("-0.5", "-.50"), ("1234.5", "1234.50"), ("2.675", "2.68"),
     ("999999999.99", "999999999.99"), ("1000000000", "1000000000.00"), ("2500000000.10", "2500000000.10"), ("-1234567890123.455", "-1234567890123.46")],
)
def test_plain_money(spark, number, text):
    assert value(spark, formats.plain_money(dec(number))) == text


def test_grouped(spark):
    assert value(spark, formats.grouped(dec("1234567.885"), 2)) == "1,234,567.89"
    assert value(spark, formats.grouped_by_value(dec("1234.00"))) == "1,234"
    assert value(spark, formats.grouped_by_value(dec("1407838.01").cast("decimal(38,2)"))) == "1,407,838.01"


def test_month_texts(spark):
    may = F.lit("1996-05-07").cast("date")
    assert value(spark, formats.padded_month_name(may)) == "May      "
    assert value(spark, formats.short_month(may)) == "May 1996" == month_label(dt.date(1996, 5, 1))
    assert value(spark, formats.year_month(may)) == "1996-05"


def test_ratio_guards(spark):
    one, zero, null = F.lit(1), F.lit(0), F.lit(None).cast("int")
    assert value(spark, ratios.ratio_or_null(one, zero)) is None
    assert value(spark, ratios.ratio_or_zero(one, zero)) == 0.0
    assert value(spark, ratios.ratio_or_zero(one, null)) is None
    assert value(spark, ratios.ratio_if_positive(one, F.lit(-1))) == 0.0
    assert value(spark, ratios.growth(F.lit(3), F.lit(2))) == 0.5
    # 57 / 200 is a tie that binary numbers miss.
    assert value(spark, ratios.rounded(ratios.ratio_or_null(F.lit(57), F.lit(200)), 2)) == Decimal("0.29")


def test_whole_days_are_cut_towards_zero(spark):
    early, late = dates.timestamp(dt.datetime(1998, 1, 1, 12)), dates.timestamp(dt.datetime(1998, 1, 4, 11))
    assert value(spark, dates.whole_days(late, early)) == 2
    assert value(spark, dates.whole_days(early, late)) == -2
    assert value(spark, dates.span_months(early, late)) == pytest.approx(71 / 24 / 30.44)


def test_local_date():
    assert dates.local_date(dt.datetime(1998, 4, 1, 7, 59), "America/Los_Angeles") == dt.date(1998, 3, 31)


def test_periods():
    pair = periods.mtd_to_midnight(dt.date(1998, 3, 31))
    assert (pair.current.start, pair.current.end, pair.current.closed) == (dt.date(1998, 3, 1), dt.date(1998, 3, 31), True)
    assert (pair.previous.start, pair.previous.end) == (dt.date(1998, 2, 1), dt.date(1998, 3, 3))
    january = periods.calendar_month(dt.date(1998, 1, 15), -1)
    assert (january.start, january.end) == (dt.date(1997, 12, 1), dt.date(1998, 1, 1))
    trailing = periods.trailing_pair(dt.date(1998, 3, 31), 30)
    assert (trailing.current.start, trailing.previous.start) == (dt.date(1998, 3, 2), dt.date(1998, 1, 31))


def test_months_in():
    assert dates.months_in(dt.date(1997, 12, 31), dt.date(1998, 2, 1)) == [
        dt.date(1997, 12, 1), dt.date(1998, 1, 1), dt.date(1998, 2, 1)]
