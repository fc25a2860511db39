"""The pipeline on small tables: what each stage keeps, and the sequences at the end."""

import re
from collections import Counter

import corpus_pipeline
from bazaarlens.llm import automata_dedup, order_minhash, quality_rules, secret_scans
from test_automata_dedup import WORD
from test_tokens import check_packing

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    columns = docs.columns
    kept, rows = docs, docs.collect()
    sizes = [len(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, FOLDER).cache()
        assert kept.columns == columns, name
        sizes.append(kept.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] == sizes[4]
    # clean documents stay, rejected ones are gone
    good = {r.doc_id for r in quality_rules.quality(docs).where("kept").collect()}
    classes = order_minhash.near_duplicates(docs.where(docs.doc_id.isin(list(good)))).collect()
    assert {r.doc_id for r in kept.collect()} == {r.class_id for r in classes}
    texts = {r.doc_id: r.text for r in kept.collect()}
    windows = Counter()
    for t in texts.values():
        words = WORD.findall(t)
        windows.update(tuple(words[i : i + automata_dedup.WINDOW]) for i in range(len(words) - automata_dedup.WINDOW + 1))
    assert not re.search("AKIA[A-Z0-9]{16}", " ".join(texts.values()))
    assert secret_scans.secrets(kept).where("n_assign + n_access + n_hex > 0").count() == 0
    original = {r.doc_id: r.text for r in rows}
    untouched = [i for i, t in texts.items() if t == original[i]]
    assert len(untouched) > 0.5 * len(texts)


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert check_packing(rows, 4096) > 0.9


def _write(spark, folder, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, key_ string, ROW_ int, scan_ int, spans_ string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and columns with names of the stages' own."""
    texts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(60).collect()]
    rows = [(i, t, "en", "s", len(t or ""), "k", 1, 2, "x") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], None, None, None, None, None, None, None), (100, None, "en", "s", None, "k", 1, 2, "x")]
    rows += [(101, "", "en", "s", 0, "k", 1, 2, "x"), (102, " ".join(texts), "en", "s", None, None, 1, 2, "x")]
    _write(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.schema.simpleString() == docs.schema.simpleString(), name
        if name == "quality rules":
            assert kept.where("text IS NULL OR text = ''").count() == 0
    # the long text shares all its passages with the others, which may lose them all
    assert 0 < kept.count() <= len(texts) + 1
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept.collect()}
    check_packing(pieces, 4096)


def test_no_rows(spark, tmp_path):
    _write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
