"""Exact top-k search over a bit-sliced index of quantised vectors.

The index holds, for each block of rows, every attribute as bitmaps: slice b of attribute d has a bit for each row that says
whether bit b of its value is set. A query's score is a sum of small multiples of attributes, so it is added up by bitmap arithmetic: all slices of
one weight go through full adders (three bitmaps to a sum and a carry) until one is left, weight by weight, for all rows of
a block at once. Negative factors take the complements of the slices, which shifts all scores alike. The slices of the sum
then select the best rows from the most significant one downward; rows that tie at the boundary are resolved by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Rows of a block of the index; queries that travel together; bytes of queries that are broadcast at once.
BLOCK, SLICE, BROADCAST = 1 << 15, 64, 16 << 20
#: Quantised components lie below this, so that products and sums stay exact in 64 bits.
LIMIT = 1 << 23
_INDEX = "block long, width int, rows int, bits int, ids array<long>, low binary, slices binary, asks binary, ask_rows array<int>"


def _pack(bits: np.ndarray) -> np.ndarray:
    """Booleans (..., rows) as 64-bit words."""
    words = -(-bits.shape[-1] // 64)
    padded = np.zeros((*bits.shape[:-1], words * 64), bool)
    padded[..., : bits.shape[-1]] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least value of each attribute, and bitmaps (attribute, bit, word) of what lies above it; values are (row, attribute)."""
    low = values.min(axis=0)
    above = (values - low).T
    bits = max(1, int(above.max(initial=0)).bit_length())
    return low, np.stack([_pack(above >> b & 1 == 1) for b in range(bits)], axis=1)


def added(slices: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Bitmaps, least significant first, of the sum over attributes of |factor| times the value or, for negative factors, its complement."""
    size, negative = np.abs(query), query < 0
    signed = np.where(negative[:, None, None], ~slices, slices)
    top = int(size.max(initial=0)).bit_length()
    chosen = [signed[size >> j & 1 == 1] for j in range(top)]
    planes, carried, weight = [], [], 0
    while weight < top + slices.shape[1] - 1 or carried:
        here = [chosen[j][:, weight - j] for j in range(top) if 0 <= weight - j < slices.shape[1]]
        held, carries = np.concatenate([*here, *carried]) if here or carried else np.zeros((0, slices.shape[2]), np.uint64), []
        while len(held) > 1:
            third = len(held) // 3
            if third:
                a, b, c, rest = held[:third], held[third : 2 * third], held[2 * third : 3 * third], held[3 * third :]
                either = a ^ b
                carries.append((a & b) | (either & c))
                held = np.concatenate([either ^ c, rest])
            else:
                carries.append(held[:1] & held[1:])
                held = held[:1] ^ held[1:]
        planes.append(held[0] if len(held) else np.zeros(slices.shape[2], np.uint64))
        carried, weight = carries, weight + 1
    return planes


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def selected(planes: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k rows of ``among`` (a bitmap) with the largest sums, ties to the smaller number."""
    sure, open_ = np.zeros_like(among), among
    for plane in reversed(planes):
        upper = open_ & plane
        n = _count(sure) + _count(upper)
        if n > k:
            open_ = upper
        else:
            sure, open_ = sure | upper, open_ & ~plane
            if n == k:
                break
    listed = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    best = listed(sure)
    return np.concatenate([best, listed(open_)[: max(0, k - len(best))]])


def quantised(vectors: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors take part, and floor(scale * component) of those."""
    keep, out = np.zeros(len(vectors), bool), []
    for k, v in enumerate(vectors):
        if v.is_valid and not v.values.null_count and len(v.values):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(invalid="ignore", over="ignore"):
                y = np.floor(x * scale)
            if np.isfinite(y).all() and (np.abs(y) < LIMIT).all():
                keep[k] = True
                out.append(y.astype(np.int64))
    return keep, out


def _blocks(scale: int, asked: str):
    schema = pa.schema([("block", pa.int64()), ("width", pa.int32()), ("rows", pa.int32()), ("bits", pa.int32()), ("ids", pa.list_(pa.int64())), ("low", pa.binary()), ("slices", pa.binary()), ("asks", pa.binary()), ("ask_rows", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        waiting: dict[int, list[tuple]] = {}

        def block(width: int) -> pa.RecordBatch:
            nonlocal number
            # in the order of ids, nulls last, so that a smaller number is a smaller id
            rows = sorted(waiting.pop(width), key=lambda r: (r[0] is None, r[0] or 0))
            values = np.stack([r[2] for r in rows])
            low, slices = slices_of(values)
            asks = np.array([r[1] for r in rows])
            cells = [part << 32 | number, width, len(rows), slices.shape[1], [r[0] for r in rows], low.tobytes(), slices.tobytes(), values[asks].astype(np.int32).tobytes(), np.flatnonzero(asks).tolist()]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, schema, strict=True)], schema=schema)

        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector"))
            keep, values = quantised(vectors, scale)
            ids, asks = (np.array(batch.column(batch.schema.get_field_index(c)).to_pylist(), object)[keep] for c in ("id", asked))
            for id_, ask, value in zip(ids, asks, values, strict=True):
                held = waiting.setdefault(len(value), [])
                held.append((id_, bool(ask), value))
                if len(held) >= BLOCK:
                    yield block(len(value))
        for width in list(waiting):
            yield block(width)

    return run


def build_index(vectors: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The bit-sliced index, a stored table of one row for each block of up to ``BLOCK`` rows of one width.

    Components become floor(scale * x), x as double. ``asks`` marks the rows that will be queries; they are kept beside their slices. Vectors that
    are null or empty, hold a null or non-finite component or one that reaches 2**23 when scaled take no part.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    blocks = max(1, -(-rows.count() // BLOCK))
    # dealt evenly, so that blocks are full however the input is cut
    return materialize(rows.repartition(blocks).mapInArrow(_blocks(scale, "asks"), _INDEX), "slices")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries of index rows in slices: block, width, numbers of their rows in the block, ids, values."""
    for batch in batches:
        for row in batch.to_pylist():
            values = np.frombuffer(row["asks"], np.int32).reshape(-1, row["width"])
            for at in range(0, len(values), SLICE):
                numbers = row["ask_rows"][at : at + SLICE]
                cells = {"block": row["block"], "width": row["width"], "numbers": numbers, "ids": [row["ids"][k] for k in numbers], "asks": values[at : at + SLICE].tobytes()}
                yield pa.RecordBatch.from_pylist([cells], schema=pa.schema([("block", pa.int64()), ("width", pa.int32()), ("numbers", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("asks", pa.binary())]))


def _found(shared, k: int, lanes: int):
    names = ["query_block", "query_row", "query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                n, width = row["rows"], row["width"]
                low = np.frombuffer(row["low"], np.int64)
                slices = np.frombuffer(row["slices"], np.uint64).reshape(width, row["bits"], -1)
                everyone = _pack(np.ones(n, bool))
                out = []
                for block, own_width, numbers, ids, asks in shared.value[row["lane"] :: lanes]:
                    if own_width != width:
                        continue
                    for number, query_id, query in zip(numbers, ids, np.frombuffer(asks, np.int32).reshape(-1, width).astype(np.int64), strict=True):
                        among = everyone
                        if block == row["block"]:
                            among = everyone.copy()
                            among[number >> 6] &= ~(np.uint64(1) << np.uint64(number & 63))
                        best = selected(added(slices, query), among, k)
                        word, bit = best >> 6, (best & 63).astype(np.uint64)
                        values = sum((slices[:, b, word] >> bit & np.uint64(1)).astype(np.int64) << b for b in range(slices.shape[1])) + low[:, None]
                        out.extend((block, number, query_id, row["ids"][j], s) for j, s in zip(best.tolist(), (query @ values).tolist(), strict=True))
                if out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def search(index: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` other rows of largest integer inner product with each query of ``index``.

    Ties go to the smaller vec_id (null last). Every row but the query's own is a candidate, copies of it and rows with its id
    too; a query that occurs twice is answered twice. Vectors of another width than the query's are not candidates. With fewer than ``k`` candidates all are
    returned. An empty table gives an empty result.

    Queries travel in slices of ``SLICE``; at most ``BROADCAST`` bytes of them are sent to the tasks at once, and each such part
    reads the index once. Large tables are cut by blocks, small ones also by lanes of queries, so that all cores work.
    """
    spark = index.sparkSession
    asked = index.mapInArrow(_asked, "block long, width int, numbers array<int>, ids array<long>, asks binary")
    asked = materialize(asked.select("*", F.monotonically_increasing_id().alias("number")), "asked")
    total = asked.agg(F.coalesce(F.sum(F.length("asks") + 12 * F.size("ids")), F.lit(0))).first()[0]
    parts = -(-total // BROADCAST)
    blocks = index.count()
    lanes = max(1, -(-2 * spark.sparkContext.defaultParallelism // max(1, blocks)))
    laned = index.select("block", "width", "rows", "bits", "ids", "low", "slices", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    laned = laned.repartition(max(1, blocks * lanes))
    found = []
    for part in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("number"), F.lit(parts)) == part).orderBy("number").drop("number")
        shared = spark.sparkContext.broadcast([tuple(r) for r in mine.collect()])  # of BROADCAST bytes or little more
        found.append(materialize(laned.mapInArrow(_found(shared, k, lanes), "query_block long, query_row int, query_id long, vec_id long, score long"), "found"))
    rank = F.row_number().over(Window.partitionBy("query_block", "query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))).alias("rank")
    if not found:
        return spark.createDataFrame([], T.StructType.fromDDL("query_id long, rank int, vec_id long, score long"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select("*", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
