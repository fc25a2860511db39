"""Nearest neighbours against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest

from bazaarlens.llm import multiprobe

SCHEMA = "vec_id bigint, embedding array<float>, c int, v string, key string"


def brute(rows, k, every):
    usable = {
        (r[0], tuple(r[1])) for r in rows
        if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    }
    out = {}
    for q, v in usable:
        if q % every == 0:
            found = sorted(
                (float(np.sqrt(((np.float32(w).astype(float) - np.float32(v).astype(float)) ** 2).sum())), i)
                for i, w in usable if i != q and len(w) == len(v)
            )
            out[q] = found[:k]
    return out


def results(frame):
    out = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def data():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 12)).astype(np.float32)
    rows = [(i, [float(a) for a in v], 1, "x", "y") for i, v in enumerate(x)]
    rows += [(1000 + i, rows[7][1], 1, "x", "y") for i in range(300)]  # copies, queries among them
    rows += [(2000 + i, [float(a) for a in x[9] + 1e-4 * rng.standard_normal(12)], 0, "", "") for i in range(200)]
    rows += [(3000, None, 1, "", ""), (3010, [], 1, "", ""), (3020, [0.0] * 12, 1, "", ""), (3030, [None] * 12, 1, "", "")]
    rows += [(3040, [float("nan")] + [1.0] * 11, 1, "", ""), (3050, [float("inf")] * 12, 1, "", ""), (None, [1.0] * 12, 1, "", "")]
    rows += [(4000, [1.0, 2.0], 1, "", ""), (4001, [1.0, 2.5], 1, "", ""), (4010, [-0.0, 1.0], 1, "", ""), rows[20], rows[20]]
    rows += [(4003, [0.0, 1.0], 1, "", "")]
    return rows


def test_sequence_of_probes():
    m, sets = 5, multiprobe.probe_sets(5, 40)
    assert sets[0] == () and sets[1] == (0,) and len(set(sets)) == len(sets) == 40
    assert all(2 * m - 1 - r not in s for s in sets for r in s)


@pytest.mark.parametrize("chunk,block", [(4096, 20_000), (16, 300)])
def test_recall_and_order(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(multiprobe, "CHUNK", chunk)
    monkeypatch.setattr(multiprobe, "BLOCK", block)
    rows = data()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got, want = results(multiprobe.nearest(frame, every=10)), brute(rows, 10, 10)
    assert set(got) == set(want)
    share = [len(set(got[q]) & set(want[q])) / max(1, len(want[q])) for q in want]
    assert np.mean(share) >= 0.9
    for q in want:
        assert len(got[q]) == len(want[q]) and got[q] == sorted(got[q])
        assert got[q][0][0] >= want[q][0][0]
    assert got[1000] == want[1000] and got[4000] == want[4000] and got[4010] == want[4010]


def test_exact_where_too_few_are_found(spark):
    rows = data()
    frame = spark.createDataFrame(rows, SCHEMA)
    narrow = multiprobe.Index(tables=1, projections=30, width=1e-7, probes=1)
    assert results(multiprobe.nearest(frame, every=10, index=narrow)) == brute(rows, 10, 10)


def test_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0], 1, "", ""), (1, [0.0, 1.0], 1, "", "")], SCHEMA)
    assert results(multiprobe.nearest(frame)) == {0: [(math.sqrt(2), 1)]}
    assert multiprobe.nearest(frame.limit(1)).count() == 0
    assert multiprobe.nearest(frame.limit(0)).count() == 0
