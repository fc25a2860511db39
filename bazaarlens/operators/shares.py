"""Shares of a total, without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_total(rows: DataFrame, value: str, keys: Sequence[str] = (), name: str = "total") -> DataFrame:
    """Add the sum of `value` over all rows with the same keys (all rows without keys), NULL where no value is known.

    Totals are combined before the shuffle and joined: one row is broadcast, totals of keys are left to Spark's own
    size check, and AQE splits a key that holds many rows. A NULL key is a key."""
    if not keys:
        return rows.crossJoin(F.broadcast(rows.agg(F.sum(value).alias(name))))
    totals = rows.groupBy(*keys).agg(F.sum(value).alias(name))
    totals = totals.select(F.col(name), *[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)))
    return rows.join(totals, same).drop(*[f"_{i}" for i in range(len(keys))])
