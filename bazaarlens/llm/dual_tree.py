"""Ranked lexical search of all documents for every item of a query table, by two trees.

Items are taken in batches of a bounded number of terms. For a batch, one pass over the documents keeps of every text
only its length and the counts of the batch's terms; Spark counts in how many documents each term lies. Then each task
builds a tree over its documents, portion by portion, and meets it with the tree over the items. A node of either tree
holds the maximum of each coordinate (weights of terms there, saturated counts here), so the product of two nodes bounds
the scores of all their pairs. Where it lies below the weakest k-th score of the node's items, the whole batch of pairs
is left out, and nothing that could be ranked is lost. Scores are whole numbers, computed exactly.

The k-th scores start from those of a pilot, the documents of one hash class in PILOT, and rise in each task. The pilot
only sets lower bounds: all documents, its own too, are then searched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .rows import portions, raw
from .storage import saved

#: Items and distinct terms of a batch at most; an item with more terms is a batch of its own.
ITEMS, TERMS = 512, 16_384
#: Documents of a tree at most, and cells of its dense table; documents and items of a leaf.
DOCS, CELLS, DOC_LEAF, ITEM_LEAF = 512, 1 << 22, 16, 4
PILOT = 32
#: Ranges in which the tasks' results are cut to k before they meet.
MEETINGS = 64

# A-Z in lower case, other letters and digits and all bytes of longer characters as they are, the rest spaces.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
VECTORS = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
FOUND = "item int, part int, doc_id bigint, score bigint"


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return text.translate(_TERM_BYTES).split()


@dataclass(frozen=True)
class Batch:
    """Items with the numbers of their terms, each once."""

    ids: list
    terms: list[list[int]]
    vocabulary: dict[bytes, int]


def batches_of(rows: Iterable[Row], items: int = ITEMS, limit: int = TERMS) -> Iterator[Batch]:
    """Rows (item_id, text) in batches; items without terms are left out."""
    ids, held, vocabulary = [], [], {}
    for row in rows:
        words = sorted(set(terms((row["text"] or "").encode())))
        new = sum(w not in vocabulary for w in words)
        if ids and (len(ids) == items or len(vocabulary) + new > limit):
            yield Batch(ids, held, vocabulary)
            ids, held, vocabulary = [], [], {}
        if words:
            ids.append(row["item_id"])
            held.append([vocabulary.setdefault(w, len(vocabulary)) for w in words])
    if ids:
        yield Batch(ids, held, vocabulary)


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with a term: doc_id, n (its terms with repeats), and numbers and counts of its known terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches):
            ids, sizes, found, counts, ends = [], [], [], [], [0]
            for doc_id, text in zip(part.column("doc_id").to_pylist(), raw(part.column("text")), strict=True):
                words = terms(text)
                if not words:
                    continue
                ids.append(doc_id)
                sizes.append(len(words))
                for word, n in Counter(words).items():
                    if word in vocabulary:
                        found.append(vocabulary[word])
                        counts.append(n)
                ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, counts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"]
            )

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(run, VECTORS)


class _Tree:
    """Rows of a dense table in an order, halved level by level down to leaves, with the maxima of every node."""

    def __init__(self, table: np.ndarray, order: np.ndarray, leaf: int):
        self.order, self.table = order, table[order]
        edges, self.edges = np.array([0, len(order)]), []
        self.edges.append(edges)
        while np.diff(edges).max() > leaf:
            edges = np.unique(np.concatenate([edges, (edges[:-1] + edges[1:]) // 2]))
            self.edges.append(edges)
        below = np.maximum.reduceat(self.table, self.edges[-1][:-1])
        self.maxima = [below]
        for edges, lower in zip(self.edges[-2::-1], self.edges[:0:-1], strict=True):
            below = np.maximum.reduceat(below, np.searchsorted(lower, edges[:-1]))
            self.maxima.insert(0, below)

    def parents(self, level: int) -> np.ndarray:
        """For the nodes of a level, their places in the level above."""
        return np.searchsorted(self.edges[level - 1], self.edges[level][:-1], side="right") - 1


def _apart(table: np.ndarray) -> np.ndarray:
    """An order in which rows with common terms are near: halves by nearness to two rows with little in common."""
    order = np.arange(len(table))

    def split(rows: np.ndarray) -> np.ndarray:
        if len(rows) <= ITEM_LEAF:
            return rows
        a = table[rows[np.argmin(table[rows] @ table[rows[0]])]]
        b = table[rows[np.argmin(table[rows] @ a)]]
        rows = rows[np.argsort(table[rows] @ (a - b), kind="stable")]
        half = len(rows) // 2
        return np.concatenate([split(rows[:half]), split(rows[half:])])

    return split(order)


class Search:
    """The best k documents of each item among those given so far."""

    def __init__(self, batch: Batch, weights: np.ndarray, least: np.ndarray, totals: tuple[int, int], k: int):
        v, n = len(batch.vocabulary), len(batch.ids)
        # Sums stay below 2^53, where doubles are exact, up to so many terms.
        self.kind = np.float64 if v <= 150_000 else np.int64
        table = np.zeros((n, v), dtype=self.kind)
        for i, held in enumerate(batch.terms):
            table[i, held] = weights[held]
        self.items = _Tree(table, _apart(table), ITEM_LEAF)
        self.least = least[self.items.order].astype(self.kind)
        self.totals, self.k, self.size = totals, k, v
        self.kept: list[list[tuple]] = [[] for _ in range(n)]
        self.pairs = 0

    def add(self, ids: list, n: np.ndarray, ends: np.ndarray, found: np.ndarray, counts: np.ndarray) -> None:
        """Documents with their numbers of terms; those of document i lie between ends[i] and ends[i + 1]."""
        documents, length = self.totals
        row = np.repeat(np.arange(len(ids)), np.diff(ends))
        norm = 50 + (50 * n * documents) // length
        table = np.zeros((len(ids), self.size), dtype=self.kind)
        tf = counts.astype(np.int64)
        table[row, found] = (1_000_000_000 * tf) // (1000 * tf + 20 * norm[row])
        # Documents that favour the same branch of the item tree stand together.
        level = self.items.maxima[min(4, len(self.items.maxima) - 1)]
        liking = table @ level.T
        order = np.lexsort((liking.max(axis=1), liking.argmax(axis=1)))
        docs = _Tree(table, order, DOC_LEAF)
        a = b = 0
        alive = np.ones((1, 1), dtype=bool)
        while True:
            alive &= self._bounds(a, b, docs, alive)
            if not alive.any() or (a + 1 == len(self.items.edges) and b + 1 == len(docs.edges)):
                break
            # The tree with more rows in a node is split first.
            if b + 1 < len(docs.edges) and (b <= a or a + 1 == len(self.items.edges)):
                b += 1
                alive = alive[:, docs.parents(b)]
            else:
                a += 1
                alive = alive[self.items.parents(a)]
        self._leaves(alive, docs, ids)

    def _bounds(self, a: int, b: int, docs: _Tree, alive: np.ndarray) -> np.ndarray:
        """Whether pairs of nodes may hold a pair that is ranked."""
        edges = self.items.edges[a]
        weakest = np.minimum.reduceat(self.least, edges[:-1])
        rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        bound = np.zeros(alive.shape, dtype=self.kind)
        bound[np.ix_(rows, cols)] = self.items.maxima[a][rows] @ docs.maxima[b][cols].T
        return (bound >= weakest[:, None]) & (bound > 0)

    def _leaves(self, alive: np.ndarray, docs: _Tree, ids: list) -> None:
        new: dict[int, list[tuple]] = {}
        edges, d_edges = self.items.edges[-1], docs.edges[-1]
        for leaf in np.flatnonzero(alive.any(axis=0)).tolist():
            nodes = np.flatnonzero(alive[:, leaf])
            rows = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in nodes])
            here = slice(d_edges[leaf], d_edges[leaf + 1])
            cols = np.flatnonzero(docs.maxima[-1][leaf] * self.items.maxima[-1][nodes].max(axis=0))
            scores = self.items.table[np.ix_(rows, cols)] @ docs.table[here][:, cols].T
            self.pairs += scores.size
            for i, j in np.argwhere((scores >= self.least[rows][:, None]) & (scores > 0)).tolist():
                doc_id = ids[docs.order[d_edges[leaf] + j]]
                new.setdefault(int(rows[i]), []).append((-int(scores[i, j]), doc_id is not None, doc_id))
        for place, found in new.items():
            held = sorted(self.kept[place] + found)[: self.k]
            self.kept[place] = held
            if len(held) == self.k:
                self.least[place] = max(self.least[place], -held[-1][0])

    def rows(self) -> list[tuple]:
        """(item, doc_id, score) of the best."""
        return [
            (int(self.items.order[place]), doc_id, -less)
            for place, held in enumerate(self.kept)
            for less, _, doc_id in held
        ]


def _searched(rows: DataFrame, batch: Batch, weights: np.ndarray, least: np.ndarray, totals: tuple, k: int) -> DataFrame:
    """Per item at least its best k of all rows of `vectors`."""
    size = max(DOC_LEAF, min(DOCS, CELLS // max(1, len(batch.vocabulary))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(batch, weights, least, totals, k)
        for whole in batches:
            for start in range(0, whole.num_rows, size):
                part = whole.slice(start, size)
                found, counts = part.column("terms"), part.column("counts")
                ends = found.offsets.to_numpy().astype(np.int64)
                search.add(
                    part.column("doc_id").to_pylist(), part.column("n").to_numpy(), ends - ends[0],
                    found.flatten().to_numpy(), counts.flatten().to_numpy(),
                )
        out = search.rows()
        task = TaskContext.get().partitionId()
        kinds = [pa.int32(), pa.int64(), pa.int64()]
        item, doc_id, score = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
        part = pa.array([task % MEETINGS] * len(out), pa.int32())
        yield pa.RecordBatch.from_arrays([item, part, doc_id, score], ["item", "part", "doc_id", "score"])

    best = rows.mapInArrow(run, FOUND)
    for keys in (["item", "part"], ["item"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best


def weight(documents: int, holding: int) -> int:
    """The weight of a term that `holding` of the documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _ranked(docs: DataFrame, batch: Batch, k: int) -> DataFrame:
    rows = saved(vectors(docs, batch.vocabulary), "term-counts")
    documents, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(batch.vocabulary), dtype=np.int64)
    # A row per term of the batch.
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():
        holding[r["term"]] = r["n"]
    weights = np.array([weight(documents, int(n)) for n in holding], dtype=np.int64)
    least = np.zeros(len(batch.ids), dtype=np.int64)
    pilot = rows.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(PILOT)) == 0)
    # A row per item of the batch.
    weakest = _searched(pilot, batch, weights, least, (documents, length), k).where(F.col("rank") == k)
    for r in weakest.select("item", "score").collect():
        least[r["item"]] = r["score"]
    best = saved(_searched(rows, batch, weights, least, (documents, length), k), "ranked")
    ids = docs.sparkSession.createDataFrame(list(enumerate(batch.ids)), "item int, item_id bigint")
    return best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items (item_id, text) the k best rows of docs (doc_id, text).

    A null or empty text has no terms: such documents don't count and such items find nothing. Equal scores rank by
    ascending doc_id, null first; rows that repeat a doc_id or an item_id are documents and items of their own. Without
    documents or items there are no rows. Very long texts are counted whole. Further columns, whatever their names, are
    left out.
    """
    rows = items.select(items["item_id"].cast("bigint").alias("item_id"), items["text"].alias("text"))
    found = [_ranked(docs, batch, k) for batch in batches_of(rows.toLocalIterator())]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    return best
