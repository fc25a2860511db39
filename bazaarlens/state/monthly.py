"""Tables kept by month in a folder, of which whole months are replaced at once.

Every replacement is a batch: its rows go to folders of their own, and then one line in `batches` makes it valid. Of a
month the last batch that covers it counts, also if that batch has no row of it. So a run that fails changes nothing, a
run that is repeated changes nothing either, and a month with late rows is simply run again. One writer at a time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.functions.dates import date, first_of_month, month_of, months_in

BATCHES = "batch int, first date, last date"
#: Columns of a table `prints` that tells which rows the months were built from.
PRINTS = "relation string, rows bigint, hashes decimal(38,0)"


def prints(rows: DataFrame, time: str, relation: str) -> DataFrame:
    """Count and sum of hashes of the rows by month; the order of columns and rows doesn't matter."""
    named = [F.struct(F.lit(c), F.col(c)) for c in sorted(rows.columns)]
    return (
        rows.select(month_of(F.col(time)).alias("month"), F.xxhash64(*named).cast("decimal(20,0)").alias("h"))
        .where("month IS NOT NULL")
        .groupBy("month")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("h").cast("decimal(38,0)").alias("hashes"))
        .withColumn("relation", F.lit(relation))
    )


def taken(printed: DataFrame) -> DataFrame:
    """The prints as they are now, for several readers: two rows per month are collected."""
    return printed.sparkSession.createDataFrame(printed.collect(), printed.schema)


class MonthlyTables:
    """`schemas` gives the columns of each table but `month`, the partition (a DATE, never NULL)."""

    def __init__(self, spark: SparkSession, root: str, schemas: Mapping[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), dict(schemas)

    def batches(self) -> list[tuple[int, dt.date, dt.date]]:
        """The valid batches in their order: number, first and last month. A line per replacement."""
        try:
            lines = self.spark.read.schema(BATCHES).parquet(f"{self.root}/batches")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((r["batch"], r["first"], r["last"]) for r in lines.collect())

    def replace(self, frames: Mapping[str, DataFrame], start: dt.date, end: dt.date) -> None:
        """Make the given rows all there is of the months from start's to end's; rows of other months are left out."""
        first, last = first_of_month(start), first_of_month(end)
        number = max((b[0] for b in self.batches()), default=0) + 1
        for name, schema in self.schemas.items():
            columns = T.StructType.fromDDL(schema).names
            rows = frames[name].where(F.col("month").between(date(first), date(last))).select(*columns, "month")
            # A month is written by few tasks, whatever the number of those before.
            rows = rows.repartition("month", F.pmod(F.xxhash64(*columns), F.lit(self._files(rows))))
            rows.write.mode("overwrite").partitionBy("month").parquet(self._folder(name, number))
        line = self.spark.createDataFrame([(number, first, last)], BATCHES)
        line.coalesce(1).write.mode("append").parquet(f"{self.root}/batches")

    def staged(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows, stored for the several tables that are built from them; the next replacement stores its own there."""
        path = f"{self.root}/staged/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _files(self, rows: DataFrame) -> int:
        return max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 16)

    def _folder(self, name: str, number: int) -> str:
        return f"{self.root}/{name}/batch={number}"

    def live(self) -> dict[int, list[dt.date]]:
        """The months that each batch is the last one of."""
        owner = {}
        for number, first, last in self.batches():
            owner.update(dict.fromkeys(months_in(first, last), number))
        out: dict[int, list[dt.date]] = {}
        for month, number in sorted(owner.items()):
            out.setdefault(number, []).append(month)
        return out

    def table(self, name: str, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
        """The valid rows of the months from first's to last's; None is open. Only their folders are read."""
        schema = T.StructType.fromDDL(f"{self.schemas[name]}, batch int, month date")
        low, high = first and first_of_month(first), last and first_of_month(last)
        wanted = {
            number: kept
            for number, months in self.live().items()
            if (kept := [m for m in months if (low is None or m >= low) and (high is None or m <= high)])
        }
        if not wanted:
            return self.spark.createDataFrame([], schema).drop("batch")
        paths = [self._folder(name, number) for number in wanted]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)
        valid = F.lit(False)
        for number, months in wanted.items():
            valid = valid | ((F.col("batch") == number) & _in_runs(F.col("month"), months))
        return rows.where(valid).drop("batch")

    def stale(self, now: DataFrame) -> DataFrame:
        """(month, relation) where the prints differ from the kept ones: months with late or changed rows, months that
        are not kept, and months that have lost all rows."""
        now = now.select("month", "relation", F.struct("rows", "hashes").alias("now"))
        kept = self.table("prints").select("month", "relation", F.struct("rows", "hashes").alias("kept"))
        both = now.join(kept, ["month", "relation"], "full")
        return both.where(~F.col("now").eqNullSafe(F.col("kept"))).select("month", "relation")

    def stale_runs(self, now: DataFrame) -> list[tuple[dt.date, dt.date]]:
        """The stale months as runs of neighbours. A row per month is collected."""
        return runs_of({r["month"] for r in self.stale(now).collect()})

    def compact(self) -> None:
        """Write all valid rows as one batch; the folders of the earlier ones are then read no more."""
        months = [m for held in self.live().values() for m in held]
        if months:
            self.replace({name: self.table(name) for name in self.schemas}, min(months), max(months))


def runs_of(months: Iterable[dt.date]) -> list[tuple[dt.date, dt.date]]:
    """First and last of each run of neighbouring months."""
    runs: list[tuple[dt.date, dt.date]] = []
    for m in sorted(months):
        if runs and first_of_month(runs[-1][1], 1) == m:
            runs[-1] = (runs[-1][0], m)
        else:
            runs.append((m, m))
    return runs


def _in_runs(month: Column, months: list[dt.date]) -> Column:
    """month is one of these, said as ranges of neighbours."""
    found = F.lit(False)
    for first, last in runs_of(months):
        found = found | month.between(date(first), date(last))
    return found
