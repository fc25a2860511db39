"""Calendar helpers. Bounds are Python dates turned into literals, so they fold and push down."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_MONTH = 86400 * 30.44  # fixed value: mean month used by the monthly rates


def timestamp(value: dt.date | dt.datetime) -> Column:
    """Zone-free timestamp literal; a date means its midnight."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time())
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def border(day: dt.date, zone: str = "UTC") -> dt.date | dt.datetime:
    """The moment, in UTC, at which a day begins in a zone (after the gap where a clock change skips midnight); the day
    itself for UTC."""
    if zone == "UTC":
        return day
    local = dt.datetime.combine(day, dt.time(), ZoneInfo(zone))
    return local.astimezone(dt.timezone.utc).replace(tzinfo=None)


def date(value: dt.date) -> Column:
    return F.lit(value.isoformat()).cast("date")


def month_of(col: Column) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(col.cast("date"), "MM")


def day_of(col: Column) -> Column:
    return col.cast("date")


def first_of_month(day: dt.date, offset: int = 0) -> dt.date:
    index = day.year * 12 + day.month - 1 + offset
    return dt.date(index // 12, index % 12 + 1, 1)


def months_in(start: dt.date, end: dt.date) -> list[dt.date]:
    """First days of every month from start's month to end's month."""
    first, last = first_of_month(start), first_of_month(end)
    count = (last.year - first.year) * 12 + last.month - first.month + 1
    return [first_of_month(first, i) for i in range(max(count, 0))]


def in_months(col: Column, start: dt.date, end: dt.date) -> Column:
    """Month of col lies between the months of start and end, as a range on the raw column."""
    return (col >= timestamp(first_of_month(start))) & (col < timestamp(first_of_month(end, 1)))


def between(col: Column, start: dt.date | dt.datetime, end: dt.date | dt.datetime) -> Column:
    """Both ends included; a date end is its midnight, so the rest of that day is out."""
    return col.between(timestamp(start), timestamp(end))


def on_days(col: Column, start: dt.date, end: dt.date) -> Column:
    """The whole of every day from start to end."""
    return (col >= timestamp(start)) & (col < timestamp(end + dt.timedelta(days=1)))


def whole_days(later: Column, earlier: Column) -> Column:
    """Full 24-hour days of the span, cut towards zero (not calendar days)."""
    return F.extract(F.lit("DAY"), later - earlier)


def span_months(first: Column, last: Column) -> Column:
    """Length of a span in mean months, with microseconds."""
    span = last - first
    seconds = (
        F.extract(F.lit("DAY"), span) * 86400
        + F.extract(F.lit("HOUR"), span) * 3600
        + F.extract(F.lit("MINUTE"), span) * 60
        + F.extract(F.lit("SECOND"), span).cast("double")
    )
    return seconds.cast("double") / F.lit(SECONDS_PER_MONTH)


def today(zone: str) -> dt.date:
    """The day it is now in a zone, for reports run as of today."""
    return local_date(dt.datetime.now(dt.timezone.utc), zone)


def as_of_today(zone: str = "UTC") -> Callable:
    """For plans (marketplace, as_of, ...): without a day they are about today, in the zone given or this one. Their
    `borders` name the zone in which days and months begin for the rows, whose times are in UTC."""

    def decorate(plan: Callable) -> Callable:
        @functools.wraps(plan)
        def run(mk, as_of: dt.date | None = None, *args, zone: str = zone, **kwargs):
            return plan(mk, as_of or today(zone), *args, **kwargs)

        return run

    return decorate


def local_date(instant: dt.datetime, zone: str) -> dt.date:
    """Calendar day of an instant (UTC when naive) in a zone."""
    if instant.tzinfo is None:
        instant = instant.replace(tzinfo=dt.timezone.utc)
    return instant.astimezone(ZoneInfo(zone)).date()
