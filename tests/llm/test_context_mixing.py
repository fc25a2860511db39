"""Context mixing: the base against plain counting, and the mix as a proper, better distribution."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from bazaarlens.llm import context_mixing as cm

FOLDER = "/root/testdata/sf0.01"


def base(rows, folds=10):
    tokens = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None] for _, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % folds == 0 for i, _ in rows]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    for (i, _), t, h in zip(rows, tokens, held):
        score = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        yield i, h, len(t), sum(count[w] > 0 for w in t), n, score


def test_base_and_gain(spark, monkeypatch):
    monkeypatch.setattr(cm, "BLOCK_BYTES", 100_000)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: r for r in cm.probabilities(docs).collect()}
    want = list(base([(r.doc_id, r.text) for r in docs.collect()]))
    assert len(got) == len(want)
    for i, *rest, score in want:
        r = got[i]
        assert [r.held_out, r.n_tokens, r.n_known, r.train_tokens] == rest
        assert r.base_score == pytest.approx(score) and r.score < 0
    held = [r for r in got.values() if r.held_out]
    assert len(held) > 50
    # The base leaves out white space and case; the mix pays for both, and learns from 2 MB only here.
    assert sum(r.score for r in held) > 1.15 * sum(r.base_score for r in held)
    n_bytes = sum(len((r.text or "").encode()) + 1 for r in docs.collect() if got[r.doc_id].held_out)
    assert -sum(r.score for r in held) * math.log2(10) / n_bytes < 2.8


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "Aa aA b", "x"), (4, "Aa aA b", "x"), (None, "b c", "x")]
    rows += [(5, "long words here " * 20000, None), (7, "é\x1cÉ \x85", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, block string")
    got = sorted(cm.probabilities(docs).collect(), key=str)
    want = sorted(base([r[:2] for r in rows]), key=str)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(
        (str(w[0]), *w[1:5], round(w[5], 4)) for w in want
    )
    assert all(r.score < 0 for r in got)
    assert cm.probabilities(docs.limit(0)).count() == 0
    assert cm.probabilities(docs.where("doc_id is null")).count() == 1


def test_code_is_complete():
    code = cm.huffman(np.arange(257) ** 2)
    assert sum(2.0 ** -len(c) for c in code) == 1.0
    assert len({tuple(c) for c in code}) == 257


def test_probabilities_add_up():
    """All texts of up to two bytes from a small code: the end symbol makes it a distribution over texts."""
    rng = np.random.default_rng(0)
    coder = cm.Coder(cm.huffman(np.ones(257)))
    odds = rng.normal(0, 1, (cm.ORDERS, cm.SLOTS)).astype(np.float32)
    weights = cm.first_weights()
    p = lambda t: math.exp(cm.mixed(coder, odds, weights, [t], cm.TEXT_RATE)[0][0])

    def prefix(t):  # probability that a text begins with t: its bits without those of the end
        bit, slots, _ = coder.bits([t])
        n = len(bit) - len(cm.huffman(np.ones(257))[cm.END])
        x = [odds[k].take(slots[k][:n]) for k in range(cm.ORDERS)]
        z = np.clip(sum(0.4 * v for v in x), -14, 14)
        q = 1 / (1 + np.exp(-z.astype(np.float64)))
        return float(np.prod(np.where(bit[:n] == 1, q, 1 - q)))

    for head in (b"", b"a", b"th"):
        assert p(head) + sum(prefix(head + bytes([b])) for b in range(256)) == pytest.approx(prefix(head), rel=1e-4)


def test_texts_together_are_texts_alone():
    rng = np.random.default_rng(1)
    coder = cm.Coder(cm.huffman(np.arange(257)))
    odds = rng.normal(0, 1, (cm.ORDERS, cm.SLOTS)).astype(np.float32)
    odds[1:][rng.random((2, cm.SLOTS)) < 0.3] = 0
    texts = [b"", b"ab", b"\0\0x", "é the \xff".encode() * 900, bytes(range(256)), b"", b"ab"]
    together = cm.mixed(coder, odds, cm.first_weights(), texts, 0.3)
    for i, t in enumerate(texts):
        alone = cm.mixed(coder, odds, cm.first_weights(), [t], 0.3)
        assert alone[0][0] == pytest.approx(together[0][i], rel=1e-4) and alone[1][0] == together[1][i]
        assert alone[2][0] == pytest.approx(together[2][i], rel=1e-3, abs=1e-4)
    groups = cm.counted(coder, iter([texts[:3], texts[3:]]))
    assert (groups == cm.counted(coder, iter([[t] for t in texts]))).all()


def test_contexts_share_no_counts(spark, monkeypatch):
    """More contexts than the fixed tables of old had slots: counts of a block's keys are those of the whole corpus, exactly."""
    monkeypatch.setattr(cm, "BLOCK_BYTES", 300_000)
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(32, 127, 4000).astype(np.uint8)).decode() for _ in range(300)]
    code = cm.huffman(np.ones(257))
    coder = cm.Coder(code)
    frame = spark.createDataFrame([(i % 4, i % 7, t) for i, t in enumerate(texts)], "block bigint, fold int, text string")
    got = cm._counts(frame, coder).where("shiftright(key, 62) = 1").groupBy("key").agg({"zeros": "max", "ones": "max"}).toArrow()
    want = Counter()
    for i, t in enumerate(texts):
        before = [0, 0, 0, 0]
        for b in [*t.encode(), cm.END]:
            context = before[3] << 27 | before[2] << 18 | before[1] << 9 | before[0]
            for node, bit in code[b]:
                want[1 << 62 | context << 8 | node, bit] += i % 7 > 1
            before = [*before[1:], b + 1]
    keys = {k for k, _ in want}
    assert len(keys) > 2 * cm.SLOTS
    rows = zip(got.column("key").to_pylist(), got.column("max(zeros)").to_pylist(), got.column("max(ones)").to_pylist())
    assert {k: (z, o) for k, z, o in rows} == {k: (want[k, 0], want[k, 1]) for k in keys}


def test_all_training_texts_count(spark):
    """The code's histogram has every training text, and the counts for scoring have fold 1 too."""
    rng = np.random.default_rng(5)
    texts = [bytes((rng.random(20) ** 3 * 120).astype(np.uint8)).decode() for _ in range(3000)]
    rows = [(i % 3, i % 5, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, block bigint, fold int, text string")
    n = np.zeros(257, dtype=np.int64)
    for _, f, t in rows:
        if f:
            n += np.bincount([*t.encode(), cm.END], minlength=257)
    code = cm.huffman(n)
    assert cm._code(frame) == code
    counts = cm._counts(frame, cm.Coder(code)).drop("block", "own").distinct()
    got = counts.groupBy().agg({"all_zeros": "sum", "all_ones": "sum", "zeros": "sum", "ones": "sum"}).first()
    size = lambda folds: sum(len(code[b]) for _, f, t in rows if f in folds for b in [*t.encode(), cm.END])
    assert got["sum(all_zeros)"] + got["sum(all_ones)"] == cm.ORDERS * size((1, 2, 3, 4))
    assert got["sum(zeros)"] + got["sum(ones)"] == cm.ORDERS * size((2, 3, 4))


def test_blocks_send_packed_pairs(spark):
    """A row for each block and part, not for each context and node; and one block's counts are those of all."""
    texts = [f"{w} {w}s and the {w} of {i % 17}" for i, w in enumerate(["house", "horse", "é", "", "mouse"] * 40)]
    rows = [(i % 4, i % 5, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "block bigint, fold int, text string")
    coder = cm.Coder(cm.huffman(np.ones(257)))
    assert cm._totals(frame, coder, 3).count() <= 4 * 3 * (cm.ORDERS + 1)
    one = spark.createDataFrame([(0, f, t) for _, f, t in rows], "block bigint, fold int, text string")
    counts = [set(cm._counts(f, coder, p).drop("block", "own").distinct().collect()) for f, p in ((frame, 3), (one, 1))]
    assert counts[0] == counts[1] and len(counts[0]) > 500


def test_packed_numbers_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) >> rng.integers(0, 60, n).astype(np.uint64))
        assert (cm.unpacked_keys(cm.packed_keys(x), len(x)) == x).all()
        assert (cm.unpacked(cm.packed(x), len(x), np.uint64) == x).all()
