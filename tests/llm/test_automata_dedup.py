"""Substring dedup against counting all windows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bazaarlens.llm import automata_dedup as ad
from bazaarlens.llm.queries import ORACLES
from compare import connect, differences

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append((len(w), int(gone.sum()), hashlib.sha256(" ".join(np.array(w, dtype=object)[~gone]).encode()).hexdigest()))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=14), st.integers(1, 3)), min_size=1, max_size=5), st.integers(1, 5))
def test_automaton_counts(weighted, window):
    a = ad.Automaton()
    count = Counter()
    for s, n in weighted:
        a.add(list(s), n)
        for i in range(len(s) - window + 1):
            count[s[i : i + window]] += n
    a.finish()
    for s, _ in weighted:
        assert a.repeated(list(s), window) == [i for i in range(len(s) - window + 1) if count[s[i : i + window]] > 1]


def texts():
    rng = np.random.default_rng(4)
    words = [f"w{i}é" for i in range(3000)]
    make = lambda n: " ".join(rng.choice(words, n))
    passage, other = make(60), make(35)
    out = [make(80) for _ in range(30)]
    out += [f"{make(int(rng.integers(0, 40)))}\n{passage}\t {make(int(rng.integers(0, 40)))}" for _ in range(80)]
    out += [f"{make(9)} {' '.join(passage.split()[a : a + 36])} {make(5)}" for a in range(0, 24, 5)]
    out += [other, other + " end", make(20) + " " + other, make(34), "", None, " \n ", out[0], out[0], "again " * 200]
    out += ["a b c d e f g " * 30, ("x y " * 17 + "z ") * 2, make(12000) + " " + passage, make(36) + "\x1c" + make(40)]
    return out


@pytest.mark.parametrize("together,group", [(2000, 2000), (3, 20)])
def test_removed(spark, monkeypatch, together, group):
    monkeypatch.setattr(ad, "TOGETHER", together)
    monkeypatch.setattr(ad, "GROUP", group)
    t = texts()
    schema = "doc_id bigint, text string, row int, row_ string, spans string, n_chars int"
    rows = [(i, x, 1, "r", "s", len(x or "")) for i, x in enumerate(t)]
    docs = spark.createDataFrame(rows + [rows[3]], schema).repartition(5)
    want = Counter((r.doc_id, *b) for r, b in zip(docs.collect(), brute([r.text for r in docs.collect()], ad.WINDOW)))
    assert Counter(map(tuple, ad.removed(docs).collect())) == want
    assert 90 < sum(k[2] > 0 for k in want)
    clean = ad.cleaned(docs)
    assert clean.schema.simpleString() == docs.schema.simpleString()
    kept = Counter()
    for r in clean.collect():
        assert r.n_chars == len(r.text or "")
        kept[r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()] += 1
    assert kept == Counter((k[0], k[3]) for k in want.elements())
    assert ad.removed(docs.limit(0)).count() == 0 and ad.cleaned(docs.limit(0)).count() == 0


def test_short_cycles(spark):
    """A word or phrase cycled within one document repeats its windows a few words apart, in one run of an anchor."""
    cycles = [" ".join(f"c{p}n{n}w{i % p}" for i in range(n)) for p in range(1, 30) for n in range(36, 71, 2)]
    t = ["ha " * 40, *cycles]
    docs = spark.createDataFrame(list(enumerate(t)), "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in ad.removed(docs).collect()}
    assert [got[i] for i in range(len(t))] == brute(t, ad.WINDOW)
    assert got[0][:2] == (40, 40)


def test_text_keeps_its_white_space():
    text = b" a b\tc\nd  e f\n"
    assert ad.without_spans(text, [{"a": 1, "b": 2}], 2) == b" a e f\n"
    assert ad.without_spans(b"a b", [{"a": 0, "b": 0}], 2) == b""


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert differences(ad.removed(docs), connect(folder), ORACLES["op6_automata_dedup"]) is None
