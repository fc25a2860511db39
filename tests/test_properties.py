"""Properties over generated values."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bazaarlens.functions import formats, ratios
from bazaarlens.functions.dates import first_of_month, months_in
from bazaarlens.operators import periods

DAYS = st.dates(dt.date(1990, 1, 1), dt.date(2030, 12, 31))


@given(DAYS)
def test_both_periods_have_the_same_length(day):
    full, midnight = periods.mtd_full_day(day), periods.mtd_to_midnight(day)
    for pair in (full, midnight):
        assert pair.current.end - pair.current.start == pair.previous.end - pair.previous.start
        assert first_of_month(pair.current.start, -1) == pair.previous.start
    assert full.current.end - midnight.current.end == dt.timedelta(days=1)


@given(DAYS, st.integers(1, 400))
def test_trailing_periods_touch(day, days):
    pair = periods.trailing_pair(day, days)
    assert pair.previous.end == pair.current.start
    assert (pair.previous.end - pair.previous.start).days == days
    assert (day - pair.current.start).days == days - 1


@given(DAYS, DAYS)
def test_months_are_unbroken(start, end):
    found = months_in(start, end)
    if found:
        assert found[0] == start.replace(day=1) and found[-1] == end.replace(day=1)
    assert all(first_of_month(a, 1) == b for a, b in zip(found, found[1:]))


@settings(max_examples=3, deadline=None)
@given(st.lists(st.decimals(-(10**9) + 1, 10**9 - 1, places=4), min_size=200, max_size=200))
def test_plain_money_reads_back(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v decimal(18,4)")
    for r in frame.select("v", formats.plain_money(F.col("v")).alias("text")).collect():
        cents = r["v"].quantize(Decimal("0.01"), ROUND_HALF_UP)
        if abs(cents) < 10**9:
            assert Decimal(r["text"]) == cents
            assert not r["text"].lstrip("-").startswith("0")


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(1, 10**4)), min_size=200, max_size=200))
def test_rounded_ratio_is_exact(spark, pairs):
    frame = spark.createDataFrame(pairs, "a bigint, b bigint")
    for r in frame.select("a", "b", ratios.rounded(ratios.ratio_or_null(F.col("a"), F.col("b")), 4).alias("q")).collect():
        # Half up in whole numbers.
        assert r["q"] == Decimal((2 * r["a"] * 10**4 + r["b"]) // (2 * r["b"])).scaleb(-4)
