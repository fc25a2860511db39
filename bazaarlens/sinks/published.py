"""Report sets that are published as a whole.

An edition is written to a folder of its own, each sheet with the positions of its rows; then its manifest (sheets, rows
and checksums) is checked against what was stored, and only the last small write makes it the edition that readers see.
A set that fails leaves the one before; a set equal to the published one changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.operators.positions import with_position

MANIFEST = (
    "edition int, number int, sheet string, path string, told_by string, rows bigint, checksum string, columns string"
)


@dataclass(frozen=True)
class Sheet:
    """A frame and the order of its rows."""

    frame: DataFrame
    order: Sequence[Column]


def checksum(frame: DataFrame, *keys: str) -> DataFrame:
    """(keys, rows, checksum) that depend on names, rows and their positions, not on files and tasks."""
    cells = [F.struct(F.lit(f.name), F.col(f"`{f.name}`").cast("string")) for f in frame.schema.fields]
    hashed = frame.select(*keys, F.xxhash64(*cells).cast("decimal(20,0)").alias("_h"))
    return hashed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_h"), F.lit(0)).cast("string").alias("checksum")
    )


class ReportSet:
    """The editions of one report set under a folder. One publisher at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> list[dict]:
        """The lines of the published edition, in the order of the sheets; none before the first."""
        try:
            lines = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        # A line per sheet and edition.
        held = [r.asDict() for r in lines.collect()]
        last = max((r["edition"] for r in held), default=0)
        return sorted((r for r in held if r["edition"] == last), key=lambda r: r["number"])

    def publish(self, sheets: Mapping[str, Sheet]) -> int:
        """Write an edition and make it the published one; returns its number, that of the present one if they are equal."""
        edition = self._next()
        lines = []
        for number, (name, sheet) in enumerate(sheets.items(), start=1):
            path = f"{self.root}/editions/{edition}/{number:02d}_{re.sub('[^A-Za-z0-9]+', '_', name)}"
            # What a failed attempt at this edition left is overwritten.
            with_position(sheet.frame, sheet.order).write.mode("overwrite").parquet(path)
            stored = self.spark.read.parquet(path)
            seen = checksum(stored).first()
            lines.append((edition, number, name, path, None, seen["rows"], seen["checksum"], _columns(stored)))
        return self._settle(edition, lines)

    def publish_together(self, rows: DataFrame, names: Sequence[str], told_by: str, order: Sequence[Column]) -> int:
        """The same for sheets with the same columns, as one frame in which `told_by` holds the name: one pass writes
        all of them. A sheet without rows is an empty sheet; rows under other names are an error."""
        edition = self._next()
        path = f"{self.root}/editions/{edition}/together"
        with_position(rows, order, [told_by]).write.mode("overwrite").partitionBy(told_by).parquet(path)
        schema = _columns(rows)
        stored = self.spark.read.schema(f"position bigint, {schema}").parquet(path)
        # A row per sheet.
        seen = {r[told_by]: r for r in checksum(stored, told_by).collect()}
        if strange := set(seen) - set(names):
            raise ValueError(f"rows of no sheet: {strange}")
        lines = []
        for number, name in enumerate(names, start=1):
            count, check = (seen[name]["rows"], seen[name]["checksum"]) if name in seen else (0, "0")
            lines.append((edition, number, name, path, told_by, count, check, f"position bigint, {schema}"))
        return self._settle(edition, lines)

    def _next(self) -> int:
        return max((r["edition"] for r in self.manifest()), default=0) + 1

    def _settle(self, edition: int, lines: list[tuple]) -> int:
        """Publish the edition unless it says what the present one says."""
        now = self.manifest()
        facts = [(r["number"], r["sheet"], r["rows"], r["checksum"], r["columns"]) for r in now]
        if now and facts == [(n, s, rows, check, columns) for _, n, s, _, _, rows, check, columns in lines]:
            return now[0]["edition"]
        self.spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return edition

    def _stored(self, line: dict) -> DataFrame:
        rows = self.spark.read.schema(line["columns"]).parquet(line["path"])
        return rows if line["told_by"] is None else rows.where(F.col(line["told_by"]) == line["sheet"])

    def sheet(self, name: str) -> DataFrame:
        """A sheet of the published edition, in its order."""
        for line in self.manifest():
            if line["sheet"] == name:
                rows = self._stored(line).orderBy("position")
                return rows if line["told_by"] is None else rows.drop(line["told_by"])
        raise KeyError(name)

    def verify(self) -> list[str]:
        """The sheets whose stored rows are no longer those of the manifest."""
        wrong = []
        for line in self.manifest():
            try:
                seen = checksum(self._stored(line)).first()
            except AnalysisException:
                wrong.append(line["sheet"])
                continue
            if (seen["rows"], seen["checksum"]) != (line["rows"], line["checksum"]):
                wrong.append(line["sheet"])
        return wrong


def _columns(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
