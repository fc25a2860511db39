"""Nearest neighbours by p-stable hashing with several probes.

A table hashes a vector to the slots of some random projections. A query looks into its own bucket of every table and
into those next to it, in the order in which they are expected to hold near vectors: by the sum of squared distances
to the borders crossed, for which a fixed sequence over the ranks of the borders stands (the expected squares of sorted
gaps). The vectors found in all tables are ranked by exact distance.

Equal vectors are one class, of which the smallest ids are kept, as many as a result can hold. Buckets meet their
probes in blocks of bounded size; a bucket or a probed key with more rows than `CHUNK` is dealt out in chunks, every
chunk of the bucket against every chunk of its probes, so no candidate is left out. Blocks send on just the nearest
few per query. Queries that find too few get an exact search.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

#: Rows of a bucket, or queries that probe one, in a chunk.
CHUNK = 4096
#: Rows of an index block, about.
BLOCK = 20_000
#: Vectors, at most, from which the number of projections is fitted, and those of them that serve as queries.
SAMPLE, SAMPLE_QUERIES = 4000, 200
#: Queries in one pass of the exact search.
EXACT = 1024
FOUND = "q bigint, c bigint, first bigint, distance double"


@dataclass(frozen=True)
class Index:
    """Parameters of the hash tables."""

    tables: int = 10
    projections: int = 8
    width: float = 2.25
    probes: int = 40
    seed: int = 7

    def hashes(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Projections, offsets and multipliers for vectors of that size, [table, ...]."""
        rng = np.random.default_rng([self.seed, size, self.projections])
        a = rng.standard_normal((self.tables, size, self.projections))
        b = rng.uniform(0, self.width, (self.tables, self.projections))
        return a, b, rng.integers(1, 2**62, (self.tables, self.projections + 1)) | 1

    def slots(self, vectors: np.ndarray, table: int) -> np.ndarray:
        a, b, _ = self.hashes(vectors.shape[1])
        return (vectors @ a[table] + b[table]) / self.width

    def key(self, slots: np.ndarray, size: int, table: int) -> np.ndarray:
        m = self.hashes(size)[2][table]
        with np.errstate(over="ignore"):
            return (slots.astype(np.int64) * m[:-1]).sum(axis=1) + m[-1]

    def bucket_keys(self, vectors: np.ndarray) -> np.ndarray:
        """[vector, table]"""
        return np.stack(
            [self.key(np.floor(self.slots(vectors, t)), vectors.shape[1], t) for t in range(self.tables)], axis=1
        )

    def probe_keys(self, vectors: np.ndarray) -> np.ndarray:
        """[vector, table * probes], nearest first in each table."""
        sets, m, rows, out = probe_sets(self.projections, self.probes), self.projections, np.arange(len(vectors)), []
        for t in range(self.tables):
            at = self.slots(vectors, t)
            low = np.floor(at)
            border = np.argsort(np.concatenate([at - low, 1 - (at - low)], axis=1), axis=1, kind="stable")
            for ranks in sets:
                slots = low.copy()
                for r in ranks:
                    side = border[:, r]
                    slots[rows, side % m] += np.where(side < m, -1, 1)
                out.append(self.key(slots, vectors.shape[1], t))
        return np.stack(out, axis=1)


def probe_sets(projections: int, n: int) -> list[tuple[int, ...]]:
    """The first n sets of border ranks (0: the nearest border of all), by the expected sum of squared gaps."""
    m, last = projections, 2 * projections - 1
    near = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    far = [1 - (j / (m + 1)) + j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(m, 0, -1)]
    cost = near + far
    found: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(found) < n:
        total, ranks = heapq.heappop(heap)
        if not any(last - r in ranks for r in ranks):  # both borders of a projection can't be crossed at once
            found.append(ranks)
        top = ranks[-1]
        if top < last:
            heapq.heappush(heap, (total - cost[top] + cost[top + 1], (*ranks[:-1], top + 1)))
            heapq.heappush(heap, (total + cost[top + 1], (*ranks, top + 1)))
    return found


def fitted(sample: np.ndarray, k: int, least_recall: float) -> Index:
    """The index with the most projections that finds the k nearest of sample queries in the sample well enough.

    Neighbours in a sample are farther away than those in all rows, so the estimate is a careful one. Widths are
    relative to the spread of the sample."""
    if len(sample) < 2 * k:
        return Index(projections=1)
    spread = float(np.sqrt(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).mean())) or 1.0
    queries = sample[:SAMPLE_QUERIES]
    rows = np.arange(len(queries))
    distance = (queries**2).sum(1)[:, None] + (sample**2).sum(1) - 2 * queries @ sample.T
    distance[rows, rows] = np.inf
    true = np.argpartition(distance, k, axis=1)[:, :k]
    index = Index(projections=1, width=Index.width * spread)
    for m in range(16, 1, -1):
        index = Index(projections=m, width=Index.width * spread)
        bucket, probe = index.bucket_keys(sample), index.probe_keys(queries)
        hit = np.zeros(true.shape, dtype=bool)
        for t in range(index.tables):
            own = probe[:, t * index.probes : (t + 1) * index.probes]
            hit |= (bucket[true, t][:, :, None] == own[:, None, :]).any(axis=2)
        if hit.mean() >= least_recall:
            break
    return index


def _vectors(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column.to_numpy(zero_copy_only=False)])


def _by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with vectors of one size."""
    sizes = np.array([len(v) for v in batch.column("v").to_numpy(zero_copy_only=False)])
    for size in np.unique(sizes):
        yield batch.take(pa.array(np.flatnonzero(sizes == size)))


def _keyed(frame: DataFrame, index: Index, probing: bool) -> DataFrame:
    """The frame of classes with the keys of their buckets, or of those to probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for part in _by_size(batch):
                    vectors = _vectors(part.column("v"))
                    keys = index.probe_keys(vectors) if probing else index.bucket_keys(vectors)
                    flat = pa.array(keys.ravel())
                    ends = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([part.column("c"), pa.ListArray.from_arrays(ends, flat)], ["c", "keys"])

    return frame.select("c", "v").mapInArrow(run, "c bigint, keys array<bigint>")


def _nearest(distance: np.ndarray, first: np.ndarray, keep: int) -> np.ndarray:
    """Places of the `keep` nearest, ties by the smaller id."""
    if len(distance) > keep:
        limit = np.partition(distance, keep - 1)[keep - 1]
        some = np.flatnonzero(distance <= limit)
    else:
        some = np.arange(len(distance))
    return some[np.lexsort((first[some], distance[some]))][:keep]


def _search(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


def _rows(found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    parts = [np.concatenate(x) if found else np.zeros(0) for x in zip(*[(np.full(len(c), q), c, f, d) for q, c, f, d in found], strict=True)]
    parts = parts or [np.zeros(0)] * 4
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    return pa.table([pa.array(p, k) for p, k in zip(parts, kinds, strict=True)], names=["q", "c", "first", "distance"])


def classes_of(table: DataFrame, id_col: str, vector_col: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """(id, v) of the rows that take part, and their classes (c, v, ids): the smallest ids of every distinct vector."""
    v = table[vector_col]
    usable = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.where(table[id_col].isNotNull() & usable).select(table[id_col].cast("bigint").alias("id"), v.alias("v"))
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("place", place).where(F.col("place") <= keep)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return rows, saved(classes.withColumn("c", F.monotonically_increasing_id()), "vector-classes")


def _hashed_search(classes: DataFrame, queries: DataFrame, index: Index, keep: int, blocks: int) -> DataFrame:
    """The nearest classes found per query class, at most `keep` for each block."""
    held = _keyed(classes, index, False).select("c", F.explode("keys").alias("key"))
    asked = _keyed(queries, index, True).select("c", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = held.select("key", F.lit(1).alias("n"), F.lit(0).alias("m"))
    sizes = sizes.unionAll(asked.select("key", F.lit(0).alias("n"), F.lit(1).alias("m")))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    large = saved(
        sizes.where((F.col("n") > CHUNK) | (F.col("m") > CHUNK)).select(
            "key", *[F.greatest(F.lit(1), F.ceil(F.col(x) / CHUNK)).cast("int").alias(f"{x}_chunks") for x in "nm"]
        ),
        "large-buckets",
    )

    def dealt(frame: DataFrame, own: str, other: str) -> DataFrame:
        joined = frame.join(large, "key", "left").na.fill(1, ["n_chunks", "m_chunks"])
        mine = F.pmod(F.xxhash64("c"), F.col(f"{own}_chunks"))
        joined = joined.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_chunks") - 1)))
        bucket = F.xxhash64("key", F.col("n").cast("int"), F.col("m").cast("int"))
        return joined.select("c", bucket.alias("bucket")).withColumn("block", F.pmod("bucket", F.lit(blocks)))

    held = dealt(held, "n", "m").join(classes.select("c", "v", F.col("ids")[0].alias("first")), "c")
    asked = dealt(asked, "m", "n").groupBy("c", "block").agg(F.collect_list("bucket").alias("buckets"))
    asked = asked.join(queries.select("c", "v"), "c")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            bucket = left.column("bucket").to_numpy()
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            vectors = left.column("v").combine_chunks().to_numpy(zero_copy_only=False)[order]
            first, c = left.column("first").to_numpy()[order], left.column("c").to_numpy()[order]
            sizes = np.array([len(v) for v in vectors])
            matrix = np.stack(vectors).astype(np.float64) if (sizes == sizes[0]).all() else None
            for q, v, keys in zip(
                right.column("c").to_pylist(), right.column("v").to_pylist(), right.column("buckets").to_pylist(), strict=True
            ):
                keys = np.array(keys)
                starts, ends = np.searchsorted(bucket, keys), np.searchsorted(bucket, keys, side="right")
                near = [np.arange(a, b) for a, b in zip(starts, ends, strict=True) if b > a]
                if not near:
                    continue
                near = np.concatenate(near)
                near = near[np.unique(c[near], return_index=True)[1]]
                query = np.array(v, dtype=np.float64)
                if matrix is None:
                    near = near[sizes[near] == len(query)]
                if len(near) and (matrix is None or matrix.shape[1] == len(query)):
                    some = np.stack(vectors[near]).astype(np.float64) if matrix is None else matrix[near]
                    distance = _search(query, some)
                    best = _nearest(distance, first[near], keep)
                    out.append((q, c[near][best], first[near][best], distance[best]))
        return _rows(out)

    grouped = held.groupBy("block").cogroup(asked.groupBy("block"))
    return grouped.applyInArrow(run, FOUND)


def _exact_search(classes: DataFrame, queries: list, keep: int) -> DataFrame:
    """The nearest classes per query of a bounded list of (c, v), at most `keep` for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_size(batch) if batch.num_rows else ():
                vectors, first, c = _vectors(part.column("v")), part.column("first").to_numpy(), part.column("c").to_numpy()
                out = []
                for q, v in queries:
                    if len(v) == vectors.shape[1]:
                        distance = _search(np.array(v, dtype=np.float64), vectors)
                        best = _nearest(distance, first, keep)
                        out.append((q, c[best], first[best], distance[best]))
                yield from _rows(out).to_batches()

    return classes.select("c", "v", F.col("ids")[0].alias("first")).mapInArrow(run, FOUND)


def nearest(
    table: DataFrame,
    k: int = 10,
    every: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least_recall: float = 0.95,
    index: Index | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows nearest by Euclidean distance to each row whose id is divisible by
    `every`, among all other rows; as many as there are where these are fewer.

    Rows with a null id, or a vector that is null, empty, zero or holds a null or non-finite number take no part. Without
    rows there are no neighbours. Further columns, whatever their names, are left out.
    Equal rows count once; rows with the same id and another vector are rows of their own. Vectors of different
    sizes are never near each other. Ties go to the smaller id.
    """
    keep = k + 1  # a query's own row is one of those found
    rows, classes = classes_of(table, id_col, vector_col, keep)
    asking = rows.where(F.col("id") % every == 0).distinct()
    queries = saved(classes.join(asking.select("v").distinct(), "v", "left_semi"), "vector-queries")
    if index is None:
        sample = classes.orderBy(F.xxhash64("c")).limit(SAMPLE).select("v").collect()
        common = max({len(r.v) for r in sample}, key=lambda n: sum(len(r.v) == n for r in sample), default=0)
        index = fitted(np.array([r.v for r in sample if len(r.v) == common], dtype=np.float64), k, least_recall)
    blocks = max(1, classes.count() * index.tables // BLOCK)
    found = saved(_hashed_search(classes, queries, index, keep, blocks), "vector-found")

    def results(found: DataFrame) -> DataFrame:
        found = found.groupBy("q", "c").agg(F.min("first").alias("first"), F.min("distance").alias("distance"))
        place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "first"))
        found = found.withColumn("place", place).where(F.col("place") <= keep)
        each = found.join(classes.select("c", "ids"), "c").select(
            "q", F.explode(F.transform("ids", lambda i: F.struct(F.col("distance").alias("score"), i.alias("vec_id")))).alias("x")
        )
        return each.groupBy("q").agg(F.slice(F.sort_array(F.collect_list("x")), 1, keep).alias("near"))

    near = saved(results(found), "vector-near")
    # How many others of its size a query has: as many as it may find.
    sizes = classes.groupBy(F.size("v").alias("n")).agg(F.sum(F.size("ids")).alias("rows"))
    short = queries.join(near, queries["c"] == near["q"], "left").join(sizes, F.size("v") == sizes["n"])
    short = saved(
        short.where(F.coalesce(F.size("near"), F.lit(0)) < F.least(F.lit(keep), "rows")).select("c", "v"), "vector-short"
    )
    passes = -(-short.count() // EXACT)
    if passes:
        exact = None
        for i in range(passes):
            some = short.where(F.pmod(F.xxhash64("c"), F.lit(passes)) == i).collect()
            part = _exact_search(classes, [(r.c, r.v) for r in some], keep)
            exact = part if exact is None else exact.unionAll(part)
        near = near.join(short, near["q"] == short["c"], "left_anti").unionByName(results(saved(exact, "vector-exact")))
    each = asking.join(classes.select("v", "c"), "v").join(near, F.col("c") == F.col("q"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return each.select(F.col("id").alias("query_id"), F.posexplode(others).alias("place", "x")).select(
        "query_id", (F.col("place") + 1).alias("rank"), "x.vec_id", "x.score"
    )
