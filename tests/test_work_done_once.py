"""The kept states work their sales out once for all tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bazaarlens import Marketplace
from bazaarlens.state.activity import ActivityState
from bazaarlens.state.distinct import DistinctState
from test_state import END, LATE, SALES, START, market, same


def counted(spark, mk):
    """The marketplace, and how many rows of its sales are worked out."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def told(value):
        seen.add(1)
        return value

    class Counted(Marketplace):
        def table(self, name, *columns, **asked):
            frame = mk.table(name, *columns, **asked)
            return frame.withColumn("seller_id", told("seller_id")) if name == "sales" else frame

    return Counted(spark, {}), seen


@pytest.mark.parametrize("state", [ActivityState, DistinctState])
def test_sales_are_worked_out_once_per_refresh(spark, tmp_path, state):
    mk, seen = counted(spark, market(spark, SALES))
    kept = state(spark, str(tmp_path))
    kept.refresh(mk, START, END)
    assert 0 < seen.value <= len(SALES)
    # Once more to see what has changed.
    seen.value = 0
    kept.update(mk)
    assert 0 < seen.value <= len(SALES)
    fresh = state(spark, f"{tmp_path}/fresh")
    seen.value = 0
    fresh.update(mk)
    assert 0 < seen.value <= 2 * len(SALES)


def test_rows_that_come_between_prints_and_tables_are_found_again(spark, tmp_path):
    before, after = market(spark, SALES), market(spark, SALES + LATE)
    calls = []

    class Growing(Marketplace):
        """The late rows come when the sales are read for the second time."""

        def table(self, name, *columns, **asked):
            calls.append(name)
            return (before if calls.count("sales") < 2 else after).table(name, *columns, **asked)

    state = ActivityState(spark, str(tmp_path))
    state.update(Growing(spark, {}))
    assert state.update(after) == [(dt.date(1998, a, 1), dt.date(1998, b, 1)) for a, b in ((1, 2), (4, 4))]
    same(after, state, "revenue", "stores")
    assert state.update(after) == []


def test_a_new_state_works_sales_and_invoices_out_once(spark, tmp_path):
    mk, seen = counted(spark, market(spark, SALES))
    calls = []

    class Asked(Marketplace):
        def table(self, name, *columns, **asked):
            calls.append(name)
            return mk.table(name, *columns, **asked)

    state = ActivityState(spark, str(tmp_path))
    state.update(Asked(spark, {}))
    assert 0 < seen.value <= len(SALES)
    assert sorted(calls) == ["invoices", "sales"]
    same(market(spark, SALES), state, "revenue", "stores")
