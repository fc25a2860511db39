"""Distinct counts over spans of months, from monthly bitmaps."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.dates import first_of_month
from bazaarlens.operators.spines import month_spine
from bazaarlens.session import shared_folder
from bazaarlens.sources.marketplace import Marketplace
from bazaarlens.state.distinct import DistinctState

LENGTHS = (1, 3, 12)


def kept(mk: Marketplace, start: dt.date, end: dt.date, folder: str | None = None) -> DistinctState:
    """The bitmaps of the months from start's to end's, built where they are not kept yet or sales have changed."""
    state = DistinctState(mk.spark, folder or shared_folder(mk.spark, "distinct", mk.name))
    state.update(mk, start, end)
    return state


def spans_ending(mk: Marketplace, start: dt.date, end: dt.date, lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """(first_month, last_month, months): spans of these lengths that end in each month of the range."""
    sizes = F.explode(F.array(*[F.lit(n) for n in lengths])).alias("months")
    rows = month_spine(mk.spark, start, end, "last_month").select("last_month", sizes)
    return rows.select(F.expr("add_months(last_month, 1 - months)").alias("first_month"), "last_month", "months")


def stores_and_invoices(
    mk: Marketplace, start: dt.date, end: dt.date, lengths: Sequence[int] = LENGTHS, state: DistinctState | None = None
) -> DataFrame:
    """Active stores and booked invoices in every span; a row per span, 0 where there is nothing."""
    first = first_of_month(start, 1 - max(lengths))
    state = state or kept(mk, first, end)
    spans = spans_ending(mk, start, end, lengths)
    out = spans
    for metric in ("stores", "invoices"):
        found = state.over_spans(spans, metric, first, end)
        # A row per span.
        out = out.join(F.broadcast(found), spans.columns, "left")
    return out.fillna(0).orderBy("last_month", "months")


def buyers_by_state(
    mk: Marketplace, start: dt.date, end: dt.date, lengths: Sequence[int] = LENGTHS, state: DistinctState | None = None
) -> DataFrame:
    """Different buyers of each state in every span."""
    first = first_of_month(start, 1 - max(lengths))
    state = state or kept(mk, first, end)
    found = state.over_spans(spans_ending(mk, start, end, lengths), "buyers", first, end, "state")
    return found.orderBy("last_month", "months", F.asc_nulls_first("state"))
