"""The manifest against a plain tree in Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from bazaarlens.llm import merkle_manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, pos int, AT string, total int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return h(*map(field, (row[0], row[3], row[2], row[4], text)))


def tree(nodes):
    """The root, and per node the (left, right) siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            start = p - p % 3
            paths[i].append((nodes[start:p], nodes[p + 1 : start + 3]))
            at[i] = p // 3
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append(r)
    trees = {}
    for source, held in by_source.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[source] = (held, *tree([leaf(r, r[1]) for r in held]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, upper = tree([trees[s][1] for s in order])
    out = Counter()
    for source, above in zip(order, upper):
        held, subroot, paths = trees[source]
        for r, path in zip(held, paths):
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for left, right in path + above:
                folded = h(*left, folded, *right)
            proof = h(*[x for left, right in path + above for x in left + right])
            out[r[0], leaf(r, r[1]), subroot, root, proof, folded, folded == root] += 1
    return out


def rows_of(n):
    rows = []
    for i in range(n):
        source = ["hot", "hot", None, "", "éa", "z", "Z"][i % 7] if i % 50 else f"s{i}"
        text = [None, "", "a\nb", "one line", "\n", "é\nñ" * 3][i % 6]
        rows.append((i * 7 - 100, text, [None, "en"][i % 2], source, None if i % 9 == 0 else i, "k", 1, "x", 2))
    return rows


@pytest.mark.parametrize("n", [1, 4, 10, 1500])
def test_manifest(spark, n):
    rows = rows_of(n)
    if n > 4:
        rows += [rows[5]] * 40 + [(None, "no id\n", "en", "hot", 1, "k", 1, "x", 2)] * 2
        rows.append((rows[7][0], "other text", "en", rows[7][3], 3, "k", 1, "x", 2))
        rows.append((10**9, "very long\n" * 200_000, "en", "hot", 3, "k", 1, "x", 2))
    got = merkle_manifest.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), block=2)
    assert Counter(map(tuple, got.collect())) == plain(rows)


def test_blocks_of_the_standard_size(spark):
    rows = [(i, f"text\n{i}", "en", "one" if i % 10 else "two", i, "k", 1, "x", 2) for i in range(700)]
    got = merkle_manifest.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert Counter(map(tuple, got.collect())) == plain(rows)


def test_no_rows(spark):
    assert merkle_manifest.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_proofs_stand_alone(spark):
    rows = rows_of(60)
    for r in merkle_manifest.proven(spark.createDataFrame(rows, SCHEMA)).collect():
        assert merkle_manifest.fold(bytes(r.leaf), bytes(r.proof)) == bytes(r.root)
        assert merkle_manifest.fold(b"x" * 32, bytes(r.proof)) != bytes(r.root)
