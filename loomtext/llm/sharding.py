"""Sharding by histogram sort: exact byte counts below candidate keys, refined until splitters fit, then one exchange.

The order is that of (hash of the text, hash of the id), so that equal texts lie side by side and a group of
copies that is larger than a shard can still be split. Keys and sizes are written once; every round counts bytes
and rows of those key prefixes in which a splitter still lies. A round's result has at most as many rows
as there are splitters times 256.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .ranges import LEAST, range_column

_BITS, _STEP = 128, 8


def _keyed(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.col(f"`{id_col}`"), F.lit(7)).alias("_k2"), (F.octet_length(text).cast("long") + 1).alias("_size")]


def _prefix(bits: int) -> list[Column]:
    """The first ``bits`` of the key as two longs, unsigned order."""
    k1, k2 = (F.col(k).bitwiseXOR(F.lit(LEAST)) for k in ("_k1", "_k2"))
    first = F.shiftrightunsigned(k1, 64 - bits) if bits < 64 else k1
    second = F.lit(0).cast("long") if bits <= 64 else F.shiftrightunsigned(k2, 128 - bits) if bits < 128 else k2
    return [first.alias("p1"), second.alias("p2")]


def _number(p1: int, p2: int, bits: int) -> int:
    """A prefix as one number of ``bits`` bits."""
    p1, p2 = p1 % 2**64, p2 % 2**64
    return p1 if bits <= 64 else p1 << (bits - 64) | p2


def splitters(keys: DataFrame, targets: list[float], slack: list[float]) -> tuple[list[int], list[int], list[int]]:
    """For each target, a 128-bit key with about that many bytes below it, and the exact bytes and rows below."""
    n = len(targets)
    found: list[int | None] = [None] * n
    below_bytes, below_rows = [0] * n, [0] * n
    # open prefix of each target: (prefix, bytes below it, rows below it)
    opened = [(0, 0, 0)] * n
    bits = 0
    while None in found and bits < _BITS:
        was, bits = bits, bits + (16 if bits == 0 else _STEP)
        live = sorted({opened[k][0] for k in range(n) if found[k] is None})
        probe = keys
        if was:
            rows = [{"p1": (p >> (was - 64) if was > 64 else p), "p2": (p & ((1 << (was - 64)) - 1) if was > 64 else 0)} for p in live]
            rows = [{k: v - 2**64 if v >= 2**63 else v for k, v in r.items()} for r in rows]
            # one row for each open splitter
            some = keys.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<p1:bigint,p2:bigint>>")))
            probe = keys.withColumns(dict(zip(("p1", "p2"), _prefix(was), strict=True))).join(F.broadcast(some), ["p1", "p2"], "left_semi")
        counted = probe.groupBy(*_prefix(bits)).agg(F.sum("_size").alias("s"), F.count(F.lit(1)).alias("c")).collect()
        by_parent: dict[int, list] = {}
        for r in counted:
            p = _number(r.p1, r.p2, bits)
            by_parent.setdefault(p >> (bits - was) if was else 0, []).append((p, r.s, r.c))
        sums = {}
        for parent, held in by_parent.items():
            held.sort()
            sums[parent] = [*accumulate(s for _, s, _ in held)], [*accumulate(c for _, _, c in held)]
        for k in range(n):
            if found[k] is not None:
                continue
            parent, size, count = opened[k]
            inside = by_parent.get(parent)
            if not inside:  # no rows at all
                found[k] = 0
                continue
            below, rows = sums[parent]
            # the first prefix that ends beyond the target, else the last
            j = min(bisect_right(below, targets[k] - size), len(inside) - 1)
            p, s, c = inside[j]
            size, count = size + below[j] - s, count + rows[j] - c
            over, under = size + s - targets[k], targets[k] - size
            opened[k] = (p, size, count)
            if min(over, under) <= slack[k] or bits >= _BITS or c == 1:
                up = over < under
                found[k] = min((p + up) << (_BITS - bits), 2**128 - 1)
                below_bytes[k], below_rows[k] = (size + s, count + c) if up else (size, count)
    return [x or 0 for x in found], below_bytes, below_rows


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, range_bytes: int = 16 << 20, ranges_per_shard: int = 2048) -> DataFrame:
    """All columns of ``docs``, then size, shard and slot.

    size is the text's UTF-8 bytes (null: none) plus one. Shards follow each other in key order; a shard's bytes
    differ from an equal share by at most ``tolerance`` of it, or by the rows that tie at a splitter. Equal texts
    are neighbours. slot counts a shard's rows from 0 without gaps. Rows with equal id and text tie: they
    stay in one shard, in any order. Null ids are allowed; columns called like a result are replaced by it; an empty table gives an
    empty result. Shards are cut into ranges of about ``range_bytes``, up to ``ranges_per_shard``, so that no task
    sorts a whole shard.
    """
    keys = materialize(docs.select(*_keyed(id_col, text_col)), "keys")
    total = keys.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    pieces = max(1, min(ranges_per_shard, round(total / shards / range_bytes)))
    n = shards * pieces
    share = total / n
    slack = [(tolerance * share * pieces / 2 if k % pieces == 0 else share / 4) for k in range(1, n)]
    bounds, _, rows = splitters(keys, [share * k for k in range(1, n)], slack)
    discard(keys)
    split = [((b >> 64) - 2**63, (b & (2**64 - 1)) - 2**63) for b in bounds]
    # exact rows below each range say where its slots begin
    start = [0, *rows]
    first = [start[k] - start[k - k % pieces] for k in range(n)]
    names = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    own = [f"_c{k}" for k in range(len(names))]
    source = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(names, own, strict=True)), *_keyed(id_col, text_col))
    dealt = range_column(source, "_k1", "_k2", split, "_range")
    number = F.row_number().over(Window.partitionBy("_range").orderBy("_k1", "_k2"))
    slot = F.element_at(F.from_json(F.lit(json.dumps(first)), "array<bigint>"), F.col("_range") + 1) + number - 1
    return dealt.select(*(F.col(k).alias(c) for c, k in zip(names, own, strict=True)), F.col("_size").alias("size"), F.floor(F.col("_range") / pieces).cast("int").alias("shard"), slot.cast("long").alias("slot"))
