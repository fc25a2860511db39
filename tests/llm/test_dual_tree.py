"""The search by two trees against scoring all pairs."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from bazaarlens.llm import dual_tree
from bazaarlens.llm.queries import ORACLES, QUERIES
from compare import connect, differences

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, n bigint, terms string, score int, part int, item string"
ITEMS = "item_id bigint, text string, rank int, DOC_ID int"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def plain(docs, items, k):
    held = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for d, c, n in held:
            m = 50 + (50 * n * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(TERM.findall(lower(text))) if t in c
            )
            if score > 0:
                found.append((-score, d is not None, d))
        out.update((item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found)[:k]))
    return out


def texts(n, seed=3):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdEé9"), rng.integers(1, 5))) for _ in range(300)]
    share = 1 / np.arange(1, 301)
    return [" ".join(rng.choice(words, rng.integers(1, 40), p=share / share.sum())) + "." for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    held = texts(1500)
    docs = [(i * 3, t) for i, t in enumerate(held)]
    docs += [(9, held[3])] * 400 + [(None, held[5])] * 3 + [(7, None), (8, ""), (11, " ..\n"), (12, "É é_E-e ²\x85x\xa0")]
    docs += [(13, " ".join(held[:700]) * 4)]
    items = [(i, t) for i, t in enumerate(texts(30, 4))]
    items += [(100, held[3]), (101, held[5]), (101, held[6]), (102, None), (103, ""), (104, "nowhere"), (None, "a b c"), (105, "é ²")]
    items += [(106, " ".join(held[:300]))]
    d = spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in docs], DOCS).repartition(7).cache()
    i = spark.createDataFrame([(*r, 1, 2) for r in items], ITEMS).repartition(3).cache()
    return docs, items, d, i


@pytest.mark.parametrize("k", [1, 20])
def test_ranks(tables, k):
    docs, items, d, i = tables
    assert Counter(map(tuple, dual_tree.ranked(d, i, k).collect())) == plain(docs, items, k)


def test_batches_of_items(tables):
    _, items, _, i = tables
    held = list(dual_tree.batches_of(i.collect(), items=10, limit=60))
    assert sum(len(b.ids) for b in held) == len([t for _, t in items if TERM.findall(t or "")])
    assert all(len(b.ids) <= 10 and (len(b.vocabulary) <= 60 or len(b.ids) == 1) for b in held) and len(held) > 3


def test_several_batches(tables, monkeypatch):
    docs, items, d, i = tables
    monkeypatch.setattr(dual_tree.batches_of, "__defaults__", (12, 200))
    assert Counter(map(tuple, dual_tree.ranked(d, i, 5).collect())) == plain(docs, items, 5)


def test_no_rows(spark, tables):
    _, _, d, i = tables
    assert dual_tree.ranked(d.limit(0), i).collect() == []
    assert dual_tree.ranked(d, i.limit(0)).collect() == []
    assert dual_tree.ranked(d, i).schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"


def test_pairs_are_left_out():
    """The bounds spare pairs of items and documents with unlike words, and those far below the weakest score."""
    rng = np.random.default_rng(1)
    rows = [{"item_id": i, "text": " ".join(f"{'ab'[i % 2]}{x}" for x in rng.integers(0, 60, 20))} for i in range(64)]
    batch = next(dual_tree.batches_of(rows))
    search = dual_tree.Search(batch, np.full(len(batch.vocabulary), 1000), np.full(64, 6_000_000), (1024, 1024 * 20), 10)
    for start in range(0, 1024, 512):
        held = [
            [v for x in rng.integers(0, 60, 20) if (v := batch.vocabulary.get(f"{'ab'[d % 2]}{x}".encode())) is not None]
            for d in range(512)
        ]
        held = [sorted(set(x)) for x in held]
        ends = np.cumsum([0, *map(len, held)])
        flat = np.concatenate([np.array(x, dtype=np.int64) for x in held])
        search.add(list(range(start, start + 512)), np.full(512, 20), ends, flat, np.ones(len(flat), dtype=np.int64))
    assert search.pairs <= 0.5 * 64 * 1024


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    frame = QUERIES["op13_dual_tree"](spark, folder)
    assert differences(frame, connect(folder), ORACLES["op13_dual_tree"]) is None
