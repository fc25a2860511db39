"""Token ids on disk in patched frame-of-reference blocks.

A dataset is a folder of Parquet files whose rows are segments: whole documents in ascending order of
id, with their lengths and one payload. A payload is

    magic 4 bytes | ids u32 | blocks u32 | place of each block u32 ... | blocks

and a block of up to 1,024 ids

    smallest id u32 | ids u16 | width u8 | 0 u8 | exceptions u16 | packed low bits | places u16 ... | values u32 ...

with all numbers little-endian. The width is the number of bits that the given share of the block's ids
needs after the smallest one is subtracted; those that need more are exceptions, whose differences stand
whole in a list. Segments hold whole documents, so any of them decodes alone, in any task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import portions
from .storage import id_and_text, saved
from .tokens import library_pieces

MAGIC = b"PFB1"
BLOCK = 1024
#: Share of a block's ids that the chosen width holds.
PERCENTILE = 0.995
#: Ids in a segment, unless one document has more.
SEGMENT = 1 << 18

SEGMENTS = (
    "shard int, segment int, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary"
)
READ = "shard int, segment int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"


def _pack(values: np.ndarray, width: int) -> bytes:
    if width == 0:
        return b""
    if width in (8, 16, 32):
        return values.astype(f"<u{width // 8}").tobytes()
    bits = (values[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros(n, dtype=np.uint32)
    if width in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{width // 8}", count=n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * width, bitorder="little")
    return bits.reshape(n, width).astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def _size(n: int, width: int) -> int:
    return (n * width + 7) // 8


def _bits(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def encode_ids(ids: np.ndarray, percentile: float = PERCENTILE, block: int = BLOCK) -> bytes:
    """The payload of unsigned 32-bit ids."""
    body, places, at = [], [], 0
    for start in range(0, len(ids), block):
        part = ids[start : start + block]
        base = part.min()
        rest = part - base
        bits = _bits(rest)
        width = int(np.partition(bits, k := min(len(bits) - 1, int(percentile * len(bits))))[k])
        odd = np.flatnonzero(bits > width)
        low = rest & np.uint32((1 << width) - 1)
        head = struct.pack("<IHBBH", int(base), len(part), width, 0, len(odd))
        data = head + _pack(low, width) + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes()
        places.append(at)
        at += len(data)
        body.append(data)
    return MAGIC + struct.pack("<II", len(ids), len(places)) + np.array(places, dtype="<u4").tobytes() + b"".join(body)


def decode_ids(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (exclusive; all by default), found by the index of block places."""
    if payload[:4] != MAGIC:
        raise ValueError("not a payload of id blocks")
    _, blocks = struct.unpack_from("<II", payload, 4)
    places = np.frombuffer(payload, dtype="<u4", count=blocks, offset=12)
    out = []
    for place in places[first:last].tolist():
        at = 12 + 4 * blocks + place
        base, n, width, _, odd = struct.unpack_from("<IHBBH", payload, at)
        at += 10
        rest = _unpack(payload[at : at + _size(n, width)], n, width)
        at += _size(n, width)
        if odd:
            where = np.frombuffer(payload, dtype="<u2", count=odd, offset=at)
            rest[where] = np.frombuffer(payload, dtype="<u4", count=odd, offset=at + 2 * odd)
        out.append(rest + np.uint32(base))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, percentile: float = PERCENTILE, segment: int = SEGMENT):
    """Encode documents (doc_id, text) and write them, ascending by doc_id, as a dataset of segments; returns it
    as read again.

    A null text is empty and has just the end id. Rows that repeat a doc_id each keep their place, next to each
    other in the order of their texts' hashes; a null doc_id comes first. Very long texts are a segment of
    their own. No rows: an empty dataset. Further columns, whatever their names, are left out.
    """
    frame = id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    frame = frame.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    end = np.array([end_id], dtype="<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, shard, number = library_pieces(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list[bytes] = []
        total = 0

        def row() -> pa.RecordBatch:
            payload = encode_ids(np.frombuffer(b"".join(held), dtype="<u4"), percentile)
            values = [[shard], [number], [total], [doc_ids], [[len(x) // 4 for x in held]], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "segment", "n_ids", "doc_ids", "lengths", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for part in portions(batches):
            for doc_id, ids in zip(
                part.column("doc_id").to_pylist(), pieces.ids(part.column("text").to_pylist()), strict=True
            ):
                n = len(ids) // 4 + 1
                if held and total + n > segment:
                    yield row()
                    doc_ids, held, total, number = [], [], 0, number + 1
                doc_ids.append(doc_id)
                held.append(ids + end)
                total += n
        if held:
            yield row()

    return saved(frame.mapInArrow(segments, SEGMENTS), "token-ids")


def read_ids(dataset: DataFrame) -> DataFrame:
    """One row per document of a dataset: its global start, number of ids and their crc32."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                data = decode_ids(row["payload"]).astype("<u4").tobytes()
                ends = np.cumsum(row["lengths"], dtype=np.int64)
                starts = ends - np.array(row["lengths"], dtype=np.int64)
                view = memoryview(data)
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * n, pa.int32()),
                        pa.array([row["segment"]] * n, pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts),
                        pa.array(row["lengths"], pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["shard", "segment", "doc_id", "before", "n_tokens", "ids_crc32"],
                )

    # Ids before a segment: totals of shards first (a row each), then within the shard.
    sizes = dataset.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_shard"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n_shard").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("in_shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(shards, "shard")
    starts = starts.select("shard", "segment", (F.col("in_shard") + F.col("shard_start")).alias("first"))
    read = dataset.select("shard", "segment", "doc_ids", "lengths", "payload").mapInArrow(documents, READ)
    return read.join(starts, ["shard", "segment"]).select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
