"""Arrow batches in bounded portions, for functions given to mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a task.
PORTION = 1 << 20


def portions(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i in range(n):
            if i > start and total + sizes[i] > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(sizes[i])
        yield batch.slice(start, n - start)


def raw(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
