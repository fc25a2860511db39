"""Near copies against alignment of all pairs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bazaarlens.llm import order_minhash as om
from bazaarlens.llm.automata_dedup import WordHashes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25), st.integers(0, 25))
def test_bands(a, b, most):
    assert om.within(np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32), most) == (distance(a, b) <= most)


def test_common_shingles(monkeypatch):
    monkeypatch.setattr(om, "COLUMNS", 3)
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 6, rng.integers(5, 12)).astype("<u4") for _ in range(30)]
    for i, row in enumerate(om.alike(seqs)):
        for j, ok in enumerate(row):
            common = sum(min((seqs[i] == v).sum(), (seqs[j] == v).sum()) for v in range(6))
            longer = max(len(seqs[i]), len(seqs[j]))
            assert ok == (longer - common <= int(0.2 * longer + 1e-9))


def test_long_alignment():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50, 3000).astype(np.uint32)
    b = np.delete(a, rng.choice(3000, 100, replace=False))
    assert om.within(a, b, 100) and not om.within(a, b, 99)


def test_labels_tell_occurrences_apart():
    x = np.array([5, 7, 5, 5, 9], dtype=np.uint64)
    assert len(set(om.labelled(x).tolist())) == 5
    assert om.labelled(x)[0] == 5
    y = np.arange(100, dtype=np.uint64)
    assert om.sketch(y) == om.sketch(y.copy()) != om.sketch(y[::-1])


def texts():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(2000)]
    make = lambda n: list(rng.choice(words, n))

    def edited(text, n):
        out = list(text)
        for at in rng.choice(len(out), n, replace=False):
            out[at] = str(rng.choice(words))
        return out

    out = [make(200) for _ in range(60)]
    original = make(300)
    out += [edited(original, int(rng.integers(0, 9))) for _ in range(60)]  # a group of near copies
    for i in range(10):
        out += [out[i], edited(out[i], 2), out[i][:-5]]
    chain = make(150)
    for _ in range(8):
        chain = edited(chain, 3)
        out.append(chain)
    out += [out[3] + make(300), make(3), make(4), make(5), make(6)]
    out = [" ".join(x) for x in out]
    return [*out, out[0], out[0].replace(" ", "\n"), "", None, " ", "a b c", "a b c", "a b  c", "x " * 5000, "x " * 5001]


def expected(rows):
    known = WordHashes()
    seqs = [om.shingles_of((t or "").encode(), known).astype("<u4") for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (len(seqs[i]) and len(seqs[j]) and om.similar(seqs[i], seqs[j])):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return groups.values()


@pytest.mark.parametrize("chunk,group", [(128, 1000), (4, 10)])
def test_near_duplicates(spark, monkeypatch, chunk, group):
    monkeypatch.setattr(om, "CHUNK", chunk)
    monkeypatch.setattr(om, "GROUP", group)
    rows = [(i * 10, t, "k", 1, len(t or "")) for i, t in enumerate(texts())]
    rows += [rows[2], (None, "only one without an id and quite unlike the rest", "k", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, row_ int, component int").repartition(6)
    groups = expected([r[:2] for r in rows])
    want = []
    for g in groups:
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        want += [(rows[i][0], min(ids, default=None), len(g)) for i in g]
    got = [tuple(r) for r in om.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = om.one_of_each(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted({k[1] for k in want}, key=str)
    assert om.near_duplicates(docs.limit(0)).count() == 0 and om.one_of_each(docs.limit(0)).count() == 0


def test_long_chain_is_one_class(spark):
    links = spark.createDataFrame([(f"n{i:04}", f"n{i + 1:04}") for i in range(300)], "a string, b string")
    rows = om.components(links).collect()
    assert len(rows) == 301 and {r.component for r in rows} == {"n0000"}
