"""Unbroken calendars and the fill of their gaps."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions.dates import date, first_of_month, month_of


def month_spine(spark: SparkSession, start: dt.date, end: dt.date, name: str = "month") -> DataFrame:
    """One row per month from start's to end's, none if end comes first."""
    return _spine(spark, first_of_month(start), first_of_month(end), "INTERVAL 1 MONTH", name)


def day_spine(spark: SparkSession, start: dt.date, end: dt.date, name: str = "day") -> DataFrame:
    return _spine(spark, start, end, "INTERVAL 1 DAY", name)


def _spine(spark: SparkSession, start: dt.date, end: dt.date, step: str, name: str) -> DataFrame:
    calendar = F.sequence(date(start), date(end), F.expr(step))
    if end < start:
        return spark.range(0).select(date(start).alias(name))
    return spark.range(1).select(F.explode(calendar).alias(name))


def months_covering(rows: DataFrame, time: str, name: str = "month") -> DataFrame:
    """One row per month between the earliest and the latest time in the rows."""
    bounds = rows.agg(F.min(time).alias("first"), F.max(time).alias("last")).where("first IS NOT NULL")
    return bounds.select(
        F.explode(
            F.sequence(month_of(F.col("first")), month_of(F.col("last")), F.expr("INTERVAL 1 MONTH"))
        ).alias(name)
    )


def fill_spine(spine: DataFrame, key: str, *facts: DataFrame, zero: Mapping[str, object] | None = None) -> DataFrame:
    """Left-join facts with at most one row per calendar step, and replace gaps.

    Broadcast is safe here: a fact holds one row per month or day, whatever the input size.
    """
    for fact in facts:
        spine = spine.join(F.broadcast(fact), key, "left")
    return spine.fillna(zero) if zero else spine
