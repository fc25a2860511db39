"""Places of rows in an order, as a column that outlasts storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.session import shared_folder


def with_position(rows: DataFrame, order: Sequence[Column], within: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Add places 1, 2, ... in the order, among all rows or among those with the same `within` columns.

    Rows are sorted in ranges and stored; the place of a row is its place in its range, and the sizes of the ranges
    before are added up: a row per range (and group), so no task sees all rows. Equal rows in the order come in any
    order, but each has its own place."""
    groups = [F.col(c).asc_nulls_first() for c in within]
    ordered = rows.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    path = shared_folder(rows.sparkSession, "ordered")
    ordered.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    stored = rows.sparkSession.read.schema(f"{_ddl(rows)}, _at bigint").parquet(path)
    stored = stored.withColumn("_part", F.shiftright("_at", 33))
    keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(within)]
    sizes = stored.groupBy(*keys, F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    grouped = [f"_g{i}" for i in range(len(within))]
    earlier = Window.partitionBy(*grouped).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    shifts = sizes.select(*grouped, "_p", (before - F.col("_first") + 1).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    placed = stored.join(shifts, same).withColumn(name, F.col("_at") + F.col("_shift"))
    return placed.select(name, *[F.col(f"`{c}`") for c in rows.columns])


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
