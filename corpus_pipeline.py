"""A training corpus from the documents table: quality rules, near-copy removal, removal of repeated passages, redaction of
secrets, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bazaarlens.llm import automata_dedup, order_minhash, packing, quality_rules, secret_scans
from bazaarlens.llm.queries import tokenizer
from bazaarlens.llm.storage import saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return order_minhash.one_of_each(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur again go from the texts; all documents stay."""
    return automata_dedup.cleaned(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; all documents stay."""
    return secret_scans.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=2, size=4096)


STAGES = [
    ("quality rules", quality_stage),
    ("near copies", near_copies_stage),
    ("repeated passages", passages_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can't express near copies and the tokenizer; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, f"stage-{i}-{name.replace(' ', '-')}")
    return docs
