"""Reporting periods relative to a given day.

The previous period starts at the previous month's first day and spans the elapsed days of the
current month. On the 31st it therefore reaches into the current month; it is not clamped.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlens.functions.dates import border, first_of_month, timestamp

DAY = dt.timedelta(days=1)


@dataclass(frozen=True)
class Period:
    """Days from start up to end, as they begin in a zone; end None is open, closed takes in the end instant.

    The borders are literals in UTC, also across a clock change, so they reach the scan."""

    start: dt.date
    end: dt.date | None
    closed: bool = False
    zone: str = "UTC"

    @property
    def span(self) -> tuple[dt.date, dt.date | None]:
        return border(self.start, self.zone), None if self.end is None else border(self.end, self.zone)

    def holds(self, col: Column) -> Column:
        first, last = self.span
        inside = col >= timestamp(first)
        if last is None:
            return inside
        return inside & (col <= timestamp(last) if self.closed else col < timestamp(last))


@dataclass(frozen=True)
class PeriodPair:
    current: Period
    previous: Period

    @property
    def span(self) -> tuple[dt.date, dt.date | None]:
        """First and last moment of the two periods, a little more at the end where it is excluded."""
        starts, ends = zip(self.current.span, self.previous.span, strict=True)
        return min(starts), None if None in ends else max(ends)

    def either(self, col: Column) -> Column:
        return self.current.holds(col) | self.previous.holds(col)


def mtd_to_midnight(as_of: dt.date, zone: str = "UTC") -> PeriodPair:
    """Current month up to the midnight that opens as_of, that instant included."""
    start, before = first_of_month(as_of), first_of_month(as_of, -1)
    current = Period(start, as_of, closed=True, zone=zone)
    return PeriodPair(current, Period(before, before + (as_of - start), zone=zone))


def mtd_full_day(as_of: dt.date, zone: str = "UTC") -> PeriodPair:
    """Current month with the whole of as_of."""
    start, before = first_of_month(as_of), first_of_month(as_of, -1)
    current = Period(start, as_of + DAY, zone=zone)
    return PeriodPair(current, Period(before, before + (as_of - start) + DAY, zone=zone))


def calendar_month(as_of: dt.date, offset: int = 0, zone: str = "UTC") -> Period:
    return Period(first_of_month(as_of, offset), first_of_month(as_of, offset + 1), zone=zone)


def month_and_previous(as_of: dt.date, zone: str = "UTC") -> PeriodPair:
    return PeriodPair(calendar_month(as_of, zone=zone), calendar_month(as_of, -1, zone))


def trailing_pair(as_of: dt.date, days: int, zone: str = "UTC") -> PeriodPair:
    """The last `days` days, open towards the future, and the `days` days before them."""
    current, past = as_of - DAY * (days - 1), as_of - DAY * (2 * days - 1)
    return PeriodPair(Period(current, None, zone=zone), Period(past, current, zone=zone))


def label_periods(pair: PeriodPair, col: Column) -> list[Column]:
    """Flags for both periods; a row may carry both when they overlap."""
    return [
        F.coalesce(pair.current.holds(col), F.lit(False)).alias("in_current"),
        F.coalesce(pair.previous.holds(col), F.lit(False)).alias("in_previous"),
    ]
