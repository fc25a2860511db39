"""The figures of a day's report for every day of a range, from one scan.

Days are counted in slots: the midnight that opens a day is one slot and the rest of the day another, so that all the
reports' periods, with closed and open ends, are runs of slots. Sums come from sums per slot. Different keys in a run
are counted where a key turns up for the first time in it: each active slot of a key knows its gap to the key's slot
before, and counts if that lies before the run. Whatever a key holds, it is then one row per active slot, and counts by
slot and gap are as few as the days.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaarlens.functions.dates import first_of_month
from bazaarlens.operators.spines import day_spine

#: Slots that a period of a month to date, or the one before it, has at most.
LONGEST = 64


def day_number(col: Column) -> Column:
    return F.unix_date(col.cast("date"))


def slot_of(time: Column) -> Column:
    """The slot of a moment: even for a midnight, odd for the rest of the day."""
    day = time.cast("date")
    return day_number(day) * 2 + F.when(time > day.cast("timestamp_ntz"), 1).otherwise(0)


def month_to_date_runs(spark: SparkSession, start: dt.date, end: dt.date, full_day: bool) -> DataFrame:
    """(as_of, period, first, last) for each day: `now`, the month up to the midnight that opens the day, or with the
    whole day, and `before`, as many days from the first of the month before."""
    as_of = F.col("as_of")
    month = F.trunc(as_of, "MM")
    before = F.add_months(month, -1)
    elapsed = F.date_diff(as_of, month)
    open_end = 1 if full_day else -1
    periods = F.array(
        F.struct(
            F.lit("now").alias("period"), (day_number(month) * 2).alias("first"),
            (day_number(as_of) * 2 + (1 if full_day else 0)).alias("last"),
        ),
        F.struct(
            F.lit("before").alias("period"), (day_number(before) * 2).alias("first"),
            ((day_number(before) + elapsed) * 2 + open_end).alias("last"),
        ),
    )
    rows = day_spine(spark, start, end, "as_of").select("as_of", F.explode(periods).alias("p"))
    return rows.select("as_of", "p.period", "p.first", "p.last")


def covered(start: dt.date, end: dt.date) -> tuple[dt.date, dt.date]:
    """First and last moment of all the runs of the days from start to end; the last one is left out or midnight."""
    last = max(end, first_of_month(end, -1) + dt.timedelta(days=31))
    return first_of_month(start, -1), last + dt.timedelta(days=1)


def _slots(runs: DataFrame) -> DataFrame:
    """A row per slot of a run; none for a run that ends before it starts."""
    within = F.when(F.col("first") <= F.col("last"), F.sequence("first", "last"))
    return runs.select("as_of", "period", "first", F.explode(within).alias("slot"))


def sums_over(runs: DataFrame, rows: DataFrame, **measures: Column) -> DataFrame:
    """(as_of, period, measures): sums over the runs of measures that rows with a `slot` have; 0 where there is nothing."""
    parts = rows.groupBy("slot").agg(*[F.sum(m).alias(name) for name, m in measures.items()])
    # Two rows per day, whatever the input size.
    found = _slots(runs).join(F.broadcast(parts), "slot").groupBy("as_of", "period")
    found = found.agg(*[F.sum(name).alias(name) for name in measures])
    return runs.select("as_of", "period").join(found, ["as_of", "period"], "left").fillna(0)


def distinct_over(runs: DataFrame, rows: DataFrame, key: str, name: str = "keys") -> DataFrame:
    """(as_of, period, keys): different non-NULL keys among rows with a `slot` in each run."""
    seen = rows.where(F.col(key).isNotNull()).select(key, "slot").distinct()
    earlier = F.lag("slot").over(Window.partitionBy(key).orderBy("slot"))
    gap = F.least(F.coalesce(F.col("slot") - earlier, F.lit(LONGEST)), F.lit(LONGEST))
    # No more rows than slots x LONGEST.
    counts = seen.withColumn("gap", gap).groupBy("slot", "gap").agg(F.count(F.lit(1)).alias("n"))
    met = _slots(runs).join(counts, "slot").where(F.col("gap") > F.col("slot") - F.col("first"))
    found = met.groupBy("as_of", "period").agg(F.sum("n").alias(name))
    return runs.select("as_of", "period").join(found, ["as_of", "period"], "left").fillna(0)


def side_by_side(figures: DataFrame, *names: str) -> DataFrame:
    """One row per as_of with `<name>_now` and `<name>_before`."""
    return figures.groupBy("as_of").agg(
        *[
            F.max(F.when(F.col("period") == p, F.col(name))).alias(f"{name}_{p}")
            for name in names for p in ("now", "before")
        ]
    )


def running_counts(changes: DataFrame, spark: SparkSession, first: int, last: int, *names: str) -> DataFrame:
    """(day, names): for every day number from first to last how many intervals of each name hold it. `changes` has
    (name, day, n): n comes on that day, or goes if negative. A task sums a name, a row per day."""
    kinds = F.explode(F.array(*[F.lit(n) for n in names])).alias("name")
    days = spark.range(first, last + 1).select(F.col("id").cast("int").alias("day"), kinds)
    by_day = changes.groupBy("name", "day").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("name").orderBy("day")
    # A row per day and name.
    filled = days.join(F.broadcast(by_day), ["name", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    counts = filled.withColumn("n", F.sum("n").over(upto))
    return counts.groupBy("day").agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in names])
