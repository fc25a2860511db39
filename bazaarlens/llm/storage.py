"""Intermediate tables in the folder that driver and executors share, and names that do not clash."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; where it is unset (tests), a folder set once per session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def saved(frame: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def bucketed(frame: DataFrame, key: str, name: str, dealt: bool = False) -> DataFrame:
    """The frame as a table in the shared folder, dealt out and sorted by a key: later joins on it don't move it. dealt: a
    task has but a few keys, and all rows of each, so they are written where they are."""
    spark = frame.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = min(100_000, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    frame = frame if dealt else frame.repartition(buckets, key)
    writer = frame.write.option("compression", "zstd").bucketBy(buckets, key).sortBy(key)
    writer.option("path", f"{shared_folder(spark)}/{table}").format("parquet").saveAsTable(table)
    return spark.table(table)


def free_name(frame: DataFrame, wish: str) -> str:
    """`wish`, with underscores added until no column has that name (in any letter case)."""
    taken = {c.lower() for c in frame.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id, text); a null text is an empty one. Other columns, whatever their names, are left out."""
    return docs.select(
        docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")
    )
