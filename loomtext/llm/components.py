"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a minimum per node and a join, so a node with many neighbours is aggregated map-side and
its rows in the join can be split; nothing gathers a neighbourhood. Each step's edges are written to the
shared folder, and the table they replace is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


#: Edges that one task can hold: up to so many, the steps run in one partition and need no exchange.
FEW = 1_000_000


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    # every edge is (larger, smaller) here
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """``edges`` (u, v) of any orientation to a written table (u, v): v is the least node that u reaches, v < u.

    Nodes without a row are their own least node. Loops and nulls are ignored; an empty table gives an empty one.
    The steps are the same whether the edges fit into one partition (up to ``few``) or are dealt out.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        held = now.coalesce(1) if seen[0] <= few else now
        wide = materialize(_large(held), "large")
        discard(now)
        now = materialize(_small(wide.coalesce(1) if seen[0] <= few else wide), "small")
        discard(wide)
        was, seen = seen, _digest(now)
        if was == seen:
            break
    return now


def spanning(linked: np.ndarray) -> np.ndarray:
    """Least node that each node of a small graph reaches, from its symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        # the least label among neighbours, then of what that one points to
        near = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def block_pairs(members: DataFrame, group: str, label: str, ident: str, size: int) -> DataFrame:
    """``members`` dealt into pairs of blocks, so that any two members of a group with different labels meet in one pair.

    Labels of over half a block have blocks of their own, cut by a hash of ``ident``; the other members of a group share blocks. Every
    member goes to each pair of blocks (_i, _j), _i <= _j, that has its own block _b; two blocks of one label are no pair.
    So a group whose members mostly have one label grows by the number of the others, and rows grow by blocks, not by members.
    """
    count = members.groupBy(group, label).agg(F.count(F.lit(1)).alias("_c"))
    named = count.select(group, F.when(F.col("_c") > size // 2, F.col(label)).alias("_big"), "_c").groupBy(group, "_big").agg(F.ceil(F.sum("_c") / size).cast("int").alias("_n"))
    each = named.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_big", "_n"))).alias("_g"), F.sum("_n").cast("int").alias("_all"))
    first = F.transform("_g", lambda x, k: F.struct(x["_big"].alias("_big"), x["_n"].alias("_n"), F.aggregate(F.slice("_g", F.lit(1), k), F.lit(0), lambda s, y: s + y["_n"]).alias("_first")))
    plan = each.select(group, "_all", F.inline(first)).where((F.col("_all") > F.col("_n")) | F.col("_big").isNull())
    every = F.sequence(F.lit(0), F.col("_all") - 1)
    meets = F.when(F.col("_big").isNull(), every).otherwise(F.array_except(every, F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)))
    plan = plan.select(group, F.coalesce(F.col("_big").isNotNull(), F.lit(False)).alias("_alone"), F.coalesce("_big", F.lit(0)).alias("_label"), "_n", "_first", meets.alias("_meets"))
    big = count.where(F.col("_c") > size // 2).select(group, label, F.lit(True).alias("_alone"))
    held = members.join(big, [group, label], "left").withColumn("_alone", F.coalesce("_alone", F.lit(False))).withColumn("_label", F.when(F.col("_alone"), F.col(label)).otherwise(0))
    own = held.join(plan, [group, "_alone", "_label"]).withColumn("_b", F.col("_first") + F.pmod(F.xxhash64(ident), F.col("_n")).cast("int"))
    each = own.withColumn("_o", F.explode("_meets"))
    return each.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_n", "_o", "_first", "_meets", "_alone", "_label")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of a sorted stream that agree on the first ``keys`` columns, one table for each run."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            v = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        first = tuple(batch.column(k)[0].as_py() for k in range(keys))
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if lo and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in range(keys))
    if held:
        yield pa.Table.from_batches(held)
