"""Small helpers for functions given to mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of text that a function takes at once from a batch.
PART = 8 << 20


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def parts(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PART) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut to about ``limit`` bytes of text, with the texts as bytes."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        sizes = batch.column(at)
        lo, total = 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_pylist()
        for k, n in enumerate(lengths):
            if k > lo and total + n > limit:
                piece = batch.slice(lo, k - lo)
                yield piece, as_bytes(piece.column(at))
                lo, total = k, 0
            total += n
        if lo < len(lengths):
            piece = batch.slice(lo)
            yield piece, as_bytes(piece.column(at))
