"""Access to the marketplace relations, wherever they live."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from bazaarlens.sources.schema import RELATIONS, schema

Span = tuple[dt.date | None, dt.date | None]


class Wanted(frozenset):
    """The columns a plan uses, and what it will keep: statuses of sales, and the first and last moment of signing or of
    creation (both included; None is open). A reader may leave out other rows; the plan filters all the same."""

    def __new__(
        cls, columns: Iterable[str], statuses: tuple[str, ...] = (), signed: Span = (None, None), created: Span = (None, None)
    ) -> Wanted:
        wanted = super().__new__(cls, columns)
        wanted.statuses, wanted.signed, wanted.created = statuses, signed, created
        return wanted


Reader = Callable[[Wanted], DataFrame]


class Marketplace:
    """Named relations, each asked for with the columns a plan uses.

    A reader is told those columns, so a derived relation can leave out joins it does not need, and
    the statuses and range of the sales that are kept, so that it can filter what it stores. `name` says which
    marketplace this is, for what is kept of it elsewhere.
    """

    def __init__(self, spark: SparkSession, readers: Mapping[str, Reader], name: str = ""):
        self.spark, self.name = spark, name
        self._readers = dict(readers)

    def table(
        self, name: str, *columns: str, statuses: tuple[str, ...] = (), signed: Span = (None, None),
        created: Span = (None, None),
    ) -> DataFrame:
        columns = tuple(dict.fromkeys(columns))
        frame = self._readers[name](Wanted(columns, statuses, signed, created))
        return frame.select(*columns) if columns else frame

    def has(self, name: str) -> bool:
        """Whether a relation is there; all but `sold_lines` always are."""
        return name in self._readers

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, ids: str = "bigint") -> Marketplace:
        """One Parquet dataset per relation under root; `ids` is the type of invoice and post ids."""
        return cls(
            spark,
            {n: lambda _, n=n: spark.read.schema(schema(n, ids)).parquet(f"{root}/{n}") for n in RELATIONS},
            root,
        )

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str, named: Mapping[str, str] | None = None) -> Marketplace:
        """Tables or views of a catalog database; `named` gives those kept elsewhere, as users in an auth schema."""
        named = named or {}
        return cls(
            spark, {n: lambda _, n=n: spark.table(named.get(n, f"{database}.{n}")) for n in RELATIONS}, database
        )

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: Mapping[str, DataFrame]) -> Marketplace:
        """Given DataFrames; a relation that is not given is empty."""
        return cls(
            spark,
            {n: lambda _, n=n: frames[n] if n in frames else spark.createDataFrame([], schema(n)) for n in RELATIONS},
        )
