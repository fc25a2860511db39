"""The queries of the training-data operators, with production parameters, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    automata_dedup,
    backtracking_bpe,
    blocks_of_ids,
    context_mixing,
    dual_tree,
    merkle_manifest,
    multiprobe,
    order_minhash,
    packing,
    pu_quality,
    quality_rules,
    secret_scans,
    weak_labels,
)

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return pu_quality.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return context_mixing.probabilities(_table(spark, folder, "documents"))


def op3_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.near_duplicates(_table(spark, folder, "documents"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"), end_id=2, size=4096)


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality(_table(spark, folder, "documents"))


def op6_automata_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return automata_dedup.removed(_table(spark, folder, "documents"))


def op7_token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    return blocks_of_ids.read_ids(blocks_of_ids.write_ids(documents, tokenizer("byte_bpe_50k.json"), end_id=0))


def op8_multiprobe(spark: SparkSession, folder: str) -> DataFrame:
    return multiprobe.nearest(_table(spark, folder, "embeddings"), k=10, every=100)


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return backtracking_bpe.encode_decode(_table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scans.secrets(_table(spark, folder, "documents"))


def op11_weak_labels(spark: SparkSession, folder: str) -> DataFrame:
    return weak_labels.personal_data(_table(spark, folder, "documents"))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest.manifest(_table(spark, folder, "documents"))


def op13_dual_tree(spark: SparkSession, folder: str) -> DataFrame:
    return dual_tree.ranked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), k=50)


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_context_mixing": op2_context_mixing,
    "op3_order_minhash": op3_order_minhash,
    "op4_packing": op4_packing,
    "op5_quality_rules": op5_quality_rules,
    "op6_automata_dedup": op6_automata_dedup,
    "op7_token_blocks": op7_token_blocks,
    "op8_multiprobe": op8_multiprobe,
    "op9_bpe": op9_bpe,
    "op10_secret_scans": op10_secret_scans,
    "op11_weak_labels": op11_weak_labels,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_dual_tree": op13_dual_tree,
}

#: DuckDB SQL where SQL can state the result on whole tables. The others are held against plain Python in the tests.
ORACLES: dict[str, str] = {
    "op6_automata_dedup": r"""
        WITH docs AS (
          SELECT row_number() OVER () AS r, doc_id,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
          FROM documents),
        windows AS (
          SELECT r, i, array_to_string(words[i:i + 34], ' ') AS sequence
          FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM docs WHERE len(words) >= 35)),
        repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY sequence) AS n FROM windows) WHERE n > 1),
        gone AS (SELECT DISTINCT r, i + k AS p FROM repeated, range(35) t(k)),
        each AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM docs),
        kept AS (
          SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
          FROM each ANTI JOIN gone USING (r, p) GROUP BY r)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
          sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (r)""",
    "op13_dual_tree": r"""
        WITH docs AS (
          SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
          FROM documents),
        totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS length FROM docs WHERE len(terms) > 0),
        counts AS (
          SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY ALL),
        weights AS (
          SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
          FROM counts, totals GROUP BY term),
        items AS (
          SELECT row_number() OVER () AS i, item_id, unnest(list_distinct(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
          FROM benchmark),
        norms AS (
          SELECT r, doc_id, 50 + (50 * CAST(len(terms) AS BIGINT) * docs) // length AS m FROM docs, totals WHERE len(terms) > 0),
        scores AS (
          SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS score
          FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN norms USING (r)
          GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank
              FROM scores WHERE score > 0)
        WHERE rank <= 50""",
}
