"""Near copies by order MinHash, verified by banded alignment.

The words of a text give a sequence of five-word shingles. Each occurrence of a shingle is labelled with its number; a
sketch takes, for every table, the labelled shingles with the smallest hashes and keeps them in the order of the text, so
texts share a key when the same shingles stand in the same order: the more likely, the smaller their edit distance.
Two texts are linked if they share a key and their shingle sequences have an edit similarity (one minus edits by the longer
length) of 0.8 or more, found by alignment within a band. Classes are the components of these links.

Equal texts are one from the start. In a bucket every text is first aligned with one centre; after that only buckets that
still hold texts of several components are compared further, across components, in chunks of bounded size. So a group of
copies costs as many alignments as it has members, and yet no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata_dedup import WordHashes, gram_hashes
from .rows import portions, raw
from .storage import free_name, saved

SHINGLE = 5
SIMILAR = 0.8
#: Tables, shingles kept in each. Texts that share just a passage seldom have all three from it.
TABLES, KEPT = 16, 3
#: Members of a bucket compared with each other at once.
CHUNK = 512
#: Cells that the alignment by diagonals may hold; beyond, alignment goes row by row.
CELLS = 1 << 22
#: Shingles counted at once for the members of a chunk pair.
COLUMNS = 8192
#: Rows of the groups that hold several chunks, about.
GROUP = 1000


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Hashes of shingles with the number of their occurrence."""
    ordered = np.sort(shingles)
    if not (ordered[1:] == ordered[:-1]).any():
        return shingles
    order = np.argsort(shingles, kind="stable")
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    number = np.arange(len(ordered)) - np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))
    out = np.empty_like(shingles)
    out[order] = ordered + _mix(number.astype(np.uint64), 77) * (number > 0)
    return out


def sketch(shingles: np.ndarray, tables: int = TABLES, kept: int = KEPT) -> list[int]:
    """A signed 64-bit key per table."""
    if not len(shingles):
        return []
    x = labelled(shingles)
    few = min(kept, len(x))
    places = np.empty((tables, few), dtype=np.int64)
    factors = _mix(np.arange(1, tables + 1, dtype=np.uint64), 3) | np.uint64(1)
    for t in range(tables):
        h = x * factors[t]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        for k in range(few):
            places[t, k] = h.argmin()
            h[places[t, k]] = np.uint64(2**64 - 1)
    places.sort(axis=1)  # in the order of the text
    keys = np.arange(tables, dtype=np.uint64)
    for k in range(few):
        keys = keys * np.uint64(0x100000001B3) + x[places[:, k]]
    return _mix(keys, 5).view(np.int64).tolist()


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance of two sequences is `most` or less, by alignment in bands that double."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    start = int(differ[0]) if len(differ) else n
    a, b = a[start:], b[start:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    end = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not len(a) or not len(b):
        return max(len(a), len(b)) <= most
    if len(a) > len(b):
        a, b = b, a
    few = min(most, max(16, CELLS // len(a)))
    if _furthest(a, b, few):
        return True
    band = few
    while band < most:
        band = min(2 * band, most)
        if len(b) - len(a) <= band and _banded(a, b, band) <= band:
            return True
    return False


def _furthest(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance is `most` or less: how far each diagonal of the band comes with 0, 1, 2, ... edits."""
    n, m = len(a), len(b)
    goal = m - n
    if goal > most:
        return False
    # On diagonal k, a[i] stands beside b[i + k]; row most + k has for each i the next i where they differ.
    differ = np.empty((2 * most + 1, n + 1), dtype=np.int32)
    own = np.arange(n + 1, dtype=np.int32)

    def fill(k: int) -> None:
        row = differ[most + k]
        row[:] = own
        i, j = max(0, -k), max(0, min(n, m - k))
        if i < j:
            unequal = np.where(a[i:j] == b[i + k : j + k], np.int32(j), own[i:j])
            row[i:j] = np.minimum.accumulate(unequal[::-1])[::-1]

    fill(0)
    far = np.full(2 * most + 3, -1, dtype=np.int32)  # one more place at both ends
    far[most + 1] = differ[most, 0]
    diagonals = np.arange(-most, most + 1, dtype=np.int32)
    limit = np.minimum(n, m - diagonals)
    for d in range(1, most + 1):
        if far[most + 1 + goal] >= n:
            return True
        fill(d)
        fill(-d)
        at = slice(most - d, most + d + 1)
        lo, hi = most - d + 1, most + d + 2
        reach = np.maximum(np.maximum(far[lo:hi], far[lo + 1 : hi + 1]) + 1, far[lo - 1 : hi - 1])
        reach = np.minimum(reach, limit[at])
        legal = reach >= np.maximum(0, -diagonals[at])
        rows = np.arange(most - d, most + d + 1)
        far[lo:hi] = np.where(legal, differ[rows, np.maximum(reach, 0)], -1)
    return bool(far[most + 1 + goal] >= n)


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Edit distance if it is `band` or less, else some larger number. Row i covers columns i - band to i + band."""
    width = 2 * band + 1
    far = band + 1
    shift = np.arange(width)
    row = np.where(shift >= band, shift - band, far)
    padded = np.concatenate([np.zeros(band, b.dtype), b, np.zeros(band + len(a), b.dtype)])
    for i in range(1, len(a) + 1):
        # column j of the row is b[i - band + j - 1]; the cell above is one to the right
        other = padded[i - 1 : i - 1 + width] != a[i - 1]
        row = np.minimum(row + other, np.append(row[1:], far) + 1)
        column = i - band + shift
        row[(column < 0) | (column > len(b))] = far
        if i <= band:
            row[band - i] = i
        row = np.minimum(np.minimum.accumulate(row - shift) + shift, far)
        if row.min() >= far:
            return far
    return int(row[len(b) - len(a) + band])


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether one minus edits by the longer length reaches the threshold."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    # Shingles without a partner each need an edit.
    ua, na = np.unique(a, return_counts=True)
    ub, nb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if longer - int(np.minimum(na[ia], nb[ib]).sum()) > most:
        return False
    return within(a, b, most)


def alike(sequences: list[np.ndarray], least: float = SIMILAR) -> np.ndarray:
    """[i, j]: whether two sequences have enough shingles in common, each as often as in both, to be similar."""
    n = len(sequences)
    sizes = np.array([len(s) for s in sequences])
    values = np.concatenate([labelled(s.astype(np.uint64)) for s in sequences])
    owner = np.repeat(np.arange(n), sizes)
    _, place, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    column = np.full(len(times), -1)
    column[shared] = np.arange(len(shared))
    column = column[place]
    common = np.zeros((n, n), dtype=np.float32)
    for at in range(0, len(shared), COLUMNS):
        here = (column >= at) & (column < at + COLUMNS)
        matrix = np.zeros((n, min(COLUMNS, len(shared) - at)), dtype=np.float32)
        matrix[owner[here], column[here] - at] = 1
        common += matrix @ matrix.T
    longer = np.maximum(sizes[:, None], sizes[None, :])
    return longer - common <= ((1 - least) * longer + 1e-9).astype(np.int64)


def shingles_of(text: bytes, known: WordHashes) -> np.ndarray:
    return gram_hashes(known.of(text.split()), SHINGLE)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (a, b) lead to. Labels go to neighbours, and then on to the label of
    the label, so paths halve each round; every round is written, and the last is that which changes nothing."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = saved(both.where("a <> b").distinct(), "links")
    labels = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        old = labels.withColumnRenamed("label", "old")
        lower = old.join(near, old["node"] == near["a"]).select("node", "old", F.least("old", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        new = lower.join(jump, "next", "left").select("node", "old", F.least("next", F.coalesce("jump", "next")).alias("label"))
        new = saved(new, "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def _links(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])


def _seq(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4")


def near_classes(texts: DataFrame) -> DataFrame:
    """(key, component) of the distinct texts (key, text) that have near copies. A key may stand in several rows."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in portions(batches):
            keys = [sketch(shingles_of(t, known)) for t in raw(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(keys, pa.list_(pa.int64()))], ["key", "buckets"])

    sketches = texts.select("key", "text").mapInArrow(sketched, "key string, buckets array<bigint>").dropDuplicates(["key"])
    held = sketches.select("key", F.explode("buckets").alias("bucket"))
    held = saved(held, "sketches")
    centres = held.groupBy("bucket").agg(F.min("key").alias("centre"), F.count("*").alias("n")).where("n > 1")
    held = saved(held.join(centres, "bucket"), "shared-buckets")

    def sequenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in portions(batches):
            rows = [shingles_of(t, known).astype("<u4").tobytes() for t in raw(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(rows, pa.binary())], ["key", "seq"])

    some = texts.join(held.select("key").distinct(), "key", "left_semi").select("key", "text")
    sequences = saved(some.mapInArrow(sequenced, "key string, seq binary").dropDuplicates(["key"]), "sequences")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            sa, sb = batch.column("seq_a").to_pylist(), batch.column("seq_b").to_pylist()
            good = [i for i in range(len(a)) if similar(_seq(sa[i]), _seq(sb[i]))]
            yield _links([a[i] for i in good], [b[i] for i in good])

    pairs = held.where("key <> centre").select(F.col("key").alias("a"), F.col("centre").alias("b")).distinct()
    pairs = pairs.join(sequences.select(F.col("key").alias("a"), F.col("seq").alias("seq_a")), "a")
    pairs = pairs.join(sequences.select(F.col("key").alias("b"), F.col("seq").alias("seq_b")), "b")
    # Alignments are long work on few bytes, so they are dealt out evenly, to as many tasks as a shuffle has.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = saved(pairs.repartition(tasks, "a").mapInArrow(aligned, "a string, b string"), "star-links")
    first = components(links)

    # Buckets that still hold several components.
    member = held.join(first, held["key"] == first["node"], "left")
    member = member.select("bucket", "key", F.coalesce("component", "key").alias("component"))
    mixed = member.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")
    )
    mixed = mixed.where("low <> high").select("bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    member = saved(member.join(mixed, "bucket"), "mixed-buckets")
    # Every chunk meets every other (and itself) once: chunk c is in the cells (c, d) and (d, c), written smaller first.
    own = F.pmod(F.xxhash64("key"), "chunks").cast("int")
    cells = member.withColumn("own", own).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select(
        F.xxhash64("bucket", F.least("own", "d"), F.greatest("own", "d")).alias("cell"), "key", "component"
    )
    cells = cells.join(sequences, "key")
    groups = max(1, member.count() // GROUP)
    cells = cells.withColumn("group", F.pmod("cell", F.lit(groups)))

    def compared(group: pa.Table) -> pa.Table:
        cell = group.column("cell").to_numpy()
        key, component = group.column("key").to_pylist(), group.column("component").to_pylist()
        seq = group.column("seq")
        order = np.argsort(cell, kind="stable")
        a, b = [], []
        for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            root = {component[r]: component[r] for r in rows}

            def find(x, root=root):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            if len(root) == 1:
                continue
            sequence = [_seq(seq[int(r)].as_py()) for r in rows]
            labels = np.unique([component[r] for r in rows], return_inverse=True)[1]
            worth = np.triu(alike(sequence), 1) & (labels[:, None] != labels[None, :])
            for i, j in np.argwhere(worth).tolist():
                x, y = find(component[rows[i]]), find(component[rows[j]])
                if x != y and within(sequence[i], sequence[j], int((1 - SIMILAR) * max(len(sequence[i]), len(sequence[j])) + 1e-9)):
                    root[x] = y
                    a.append(key[rows[i]])
                    b.append(key[rows[j]])
        return pa.Table.from_batches([_links(a, b)])

    more = cells.select("group", "cell", "key", "component", "seq").groupBy("group").applyInArrow(compared, "a string, b string")
    more = saved(more, "more-links")
    if more.isEmpty():
        return first.select(F.col("node").alias("key"), "component")
    return components(links.unionAll(more)).select(F.col("node").alias("key"), "component")


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """The documents with the hash of their texts. Equal texts, null and empty ones among them, have equal hashes."""
    return docs.withColumn(key, F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size): documents of a class are equal or near copies of each other, directly or by steps.

    class_id is the smallest doc_id of the class. Texts of fewer than five words are only alike when equal; null texts
    count as empty and so are alike. Rows that repeat each get a row; rows with a null doc_id take part, and a class with
    no other rows has a null class_id. Very long texts are compared whole. No rows: none. Further columns, whatever their
    names, are left out."""
    rows = _keyed(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]), "key")
    near = near_classes(rows)
    few = rows.select("doc_id", "key").join(near, "key", "left")
    few = few.select("doc_id", F.coalesce("component", "key").alias("component"))
    few = saved(few, "document-components")
    classes = few.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return few.join(classes, "component").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of every class, that with the smallest doc_id (null last, then by the hash of the text), whole and with
    its columns as they were, whatever their names. Very long texts are compared whole. No rows: none."""
    key, row = free_name(docs, "key_"), free_name(docs, "row_")
    rows = saved(_keyed(docs, key).withColumn(row, F.monotonically_increasing_id()), "keyed-documents")
    near = near_classes(rows.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text")))
    few = rows.select(F.col(key).alias("key"), F.col(row).alias("row"), F.col("doc_id").alias("id")).join(near, "key", "left")
    order = F.struct(F.col("id").isNull().alias("x"), "id", "key", "row")
    best = few.groupBy(F.coalesce("component", "key").alias("component")).agg(F.min(order).alias("best"))
    best = best.select(F.col("best.row").alias(row))
    return rows.join(best, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
