"""Packing documents into sequences: shortest pack first over the histogram of lengths.

Documents become ids with an end id; one of more than the sequence length is cut into full pieces and a rest.
The histogram of piece lengths (as many bars as a sequence has places) goes to the driver, which fills packing
patterns, longest length first: a length goes to the pattern with the most room, splitting its count when fewer
pieces are left. Pieces then find their slot by length and rank. Ranks need no sort: each task counts its own
pieces of a length, and the counts of the tasks before are added.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import portions
from .storage import id_and_text, saved
from .tokens import library_pieces

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, in_part bigint"
)
PACKED = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(count, [(length, copies), ...]) per packing pattern, for {length: pieces}.

    Each length splits one pattern and opens two at most, so there are no more than three times `size`.
    """
    done: list[tuple[int, list[tuple[int, int]]]] = []
    tie = count()
    room: list = []  # heap of (-free places, tie, count, pattern)

    def put(free: int, n: int, pattern: list[tuple[int, int]]) -> None:
        if n and free:
            heapq.heappush(room, (-free, next(tie), n, pattern))
        elif n:
            done.append((n, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and room and -room[0][0] >= length:
            free, _, n, pattern = heapq.heappop(room)
            copies = 1 if left <= n else min(-free // length, left // n)
            used = min(n, left // copies)
            put(-free - copies * length, used, [*pattern, (length, copies)])
            put(-free, n - used, pattern)
            left -= used * copies
        most = size // length
        if left:
            put(size - most * length, left // most, [(length, most)])
            put(size - left % most * length, int(left % most > 0), [(length, left % most)])
    done += [(n, pattern) for _, _, n, pattern in sorted(room)]
    return done


def slots(histogram: dict[int, int], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first ranks, first sequence ids, offsets and copies a sequence of the runs of slots."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for n, pattern in patterns(histogram, size):
        offset = 0
        for length, copies in pattern:
            rank = given.get(length, 0)
            found.setdefault(length, []).append((rank, sequence, offset, copies))
            given[length] = rank + n * copies
            offset += length * copies
        sequence += n
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in found.items()}


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, size: int, space: str) -> DataFrame:
    """The pieces of the documents, with the number of the task and the rank among its pieces of that length."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = library_pieces(tokenizer, space), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        for part in portions(batches):
            out: list[tuple] = []
            for doc_id, ids in zip(
                part.column("doc_id").to_pylist(), own.ids(part.column("text").to_pylist()), strict=True
            ):
                data = ids + end
                total = len(data) // 4
                for start in range(0, total, size):
                    length = min(size, total - start)
                    crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                    out.append((doc_id, start, length, crc, total, task, int(seen[length])))
                    seen[length] += 1
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "in_part"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names
            )

    return id_and_text(docs).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, space: str = "") -> DataFrame:
    """Pieces of all documents with their sequence and offset there.

    A null or empty text is a piece with just the end id. Rows that repeat a doc_id are documents of their own.
    Pieces of the same length are in the order of their tasks and of the rows there. Very long texts are cut into pieces
    of the size. No rows: no pieces. Further columns, whatever their names, are left out.
    """
    pieces = saved(pieces_of(docs, tokenizer, end_id, size, space), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = saved(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "piece-counts")
    bars = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row per length, `size` at most
    places = slots({r["length"]: r["n"] for r in bars}, size)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(rows):
                    value = int(length[rows[0]])
                    ranks, sequences, offsets, copies = places[value]
                    run = np.searchsorted(ranks, rank[rows], side="right") - 1
                    step, copy = np.divmod(rank[rows] - ranks[run], copies[run])
                    sequence[rows] = sequences[run] + step
                    offset[rows] = offsets[run] + copy * value
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            columns = [*map(batch.column, names), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    # A row per task and length: its file is small, but it grows with the data, so it is not broadcast.
    ranked = pieces.join(counts.select("part", "length", "before").hint("merge"), ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("in_part"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(assign, PACKED)
