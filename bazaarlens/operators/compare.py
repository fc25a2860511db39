"""The same measure in two periods, from one scan."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.operators.periods import PeriodPair, label_periods

Measure = Callable[[Column], Column]


def compare_periods(
    rows: DataFrame, time: str, pair: PeriodPair, measures: Mapping[str, Measure]
) -> DataFrame:
    """One row with `<name>_now` and `<name>_before` per measure.

    A measure gets the flag column of a period and returns an aggregate over the flagged rows.
    """
    flagged = rows.where(pair.either(F.col(time))).select("*", *label_periods(pair, F.col(time)))
    return flagged.agg(
        *[
            build(F.col(flag)).alias(f"{name}_{suffix}")
            for name, build in measures.items()
            for flag, suffix in (("in_current", "now"), ("in_previous", "before"))
        ]
    )


def distinct_in_periods(rows: DataFrame, key: str, time: str, pair: PeriodPair) -> DataFrame:
    """Distinct non-NULL keys in each period as `keys_now` and `keys_before`.

    Keys collapse before the shuffle, so a hot key costs one row per map task.
    """
    seen = (
        rows.where(pair.either(F.col(time)) & F.col(key).isNotNull())
        .select(key, *label_periods(pair, F.col(time)))
        .groupBy(key)
        .agg(F.max("in_current").alias("in_current"), F.max("in_previous").alias("in_previous"))
    )
    return seen.agg(
        F.count_if("in_current").alias("keys_now"), F.count_if("in_previous").alias("keys_before")
    )
