"""Positive-unlabelled quality: held-out accuracy, and defined results for odd rows."""

import zlib

import numpy as np

from bazaarlens.llm import pu_quality

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in pu_quality.quality(docs, labels).collect()}
    assert len(rows) == docs.count()
    truth = [(r.quality, rows[r.doc_id]) for r in labels.collect()]
    for q, r in truth:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.7)
    held = [(q, r) for q, r in truth if r.held_out]
    good, bad = ([r.score for q, r in held if q == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([r.predicted == q for q, r in held]) > 0.93


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "x", 0.1), (2, "", "x", 0.1), (3, "a", "x", 0.1), (3, "a", "x", 0.1), (None, "words here " * 20000, None, None)],
        "doc_id bigint, text string, kind string, score double",
    )
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1), (3, 1)], "doc_id bigint, quality int")
    rows = pu_quality.quality(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "2", "3", "3", "None"]
    assert all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert pu_quality.quality(docs.limit(0), labels).count() == 0
    assert pu_quality.quality(docs, labels.limit(0)).count() == 5


def test_one_id_on_a_third_of_all_rows(spark):
    """The training sample holds an id once, so its copies neither fill it nor multiply."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    hot = docs.where("doc_id = 5").crossJoin(spark.range(500)).drop("id")
    alone = {r.doc_id: r.score for r in pu_quality.quality(docs, labels).collect()}
    rows = pu_quality.quality(docs.unionByName(hot), labels).collect()
    assert len(rows) == 1500 and all(abs(r.score - alone[r.doc_id]) < 1e-9 for r in rows)


def test_the_prior_needs_no_negatives(spark):
    """Estimated from positives and unlabelled texts, it is near the share that the labels give."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    texts = dict(docs.select("doc_id", "text").collect())
    known = {r.doc_id: r.quality for r in labels.collect()}
    ids = sorted(known)
    share = sum(known[i] == 1 for i in ids) / len(ids)
    good = np.array([pu_quality.features((texts[i] or "").encode()) for i in ids if known[i] == 1], dtype=np.float64)
    web = np.array([pu_quality.features((texts[i] or "").encode()) for i in sorted(texts)[::3]], dtype=np.float64)
    assert abs(pu_quality.estimated_prior(good, web) - share) < 0.08
    # and follows the unlabelled side: only bad texts beside half as many good ones
    bad = np.array([pu_quality.features((texts[i] or "").encode()) for i in ids if known[i] == 0], dtype=np.float64)
    mixed = np.concatenate([bad, good[: len(bad) // 2]])
    assert abs(pu_quality.estimated_prior(good[len(bad) // 2 :], mixed) - 1 / 3) < 0.12


def test_risk_learns_from_unlabelled_text():
    rng = np.random.default_rng(0)
    good = rng.normal(0, 1, (2000, pu_quality.N_FEATURES))
    bad = rng.normal(0, 1, (600, pu_quality.N_FEATURES))
    bad[:, :5] += 3
    model = pu_quality.trained(good[:1000], np.concatenate([good[1000:], bad]), 1000 / 1600)
    assert (model.score(good) > 0.5).mean() > 0.9 and (model.score(bad) < 0.5).mean() > 0.9
