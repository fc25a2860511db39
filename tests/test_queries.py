"""Every query against its SQL, with the standard arguments and with another set."""

import datetime as dt

import pytest

import __spark_entry__ as entry
from bazaarlens.plans.catalog import PLANS, ReportArgs
from compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
# The range ends inside the data, at a midnight; as_of is an ordinary day.
OTHER = ReportArgs(
    as_of=dt.date(1998, 6, 20), start=dt.date(1996, 1, 15), end=dt.date(1996, 11, 30),
    now=dt.datetime(1998, 1, 1, 7, 59), churn_days=90, min_sales=1, min_posts=1,
    sub_start=dt.date(1996, 3, 5), sub_end=dt.date(1996, 8, 20),
)
# tested with other arguments elsewhere
LONG = ("_by_day", "_kept", "_spans")
FIRST_DAY = ReportArgs(as_of=dt.date(1998, 5, 1), min_sales=0)


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", PLANS)
def test_standard(spark, duck, name):
    assert differences(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", [n for n in PLANS if n.startswith(("r", "t05", "t08", "m0", "m15", "m23")) and not n.endswith(LONG)])
def test_other_arguments(spark, duck, name):
    assert differences(entry.queries(OTHER)[name](spark, FOLDER), duck, entry.oracle_sql(OTHER)[name]) is None


@pytest.mark.parametrize(
    "name",
    [n for n in PLANS if n.startswith(("r05", "r06", "r07", "r08", "r09", "r1", "r2", "m01", "m02")) and not n.endswith(LONG)],
)
def test_first_day_of_month_and_no_threshold(spark, duck, name):
    assert differences(entry.queries(FIRST_DAY)[name](spark, FOLDER), duck, entry.oracle_sql(FIRST_DAY)[name]) is None


def test_names_match():
    assert set(PLANS) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
