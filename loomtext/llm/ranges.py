"""Deal rows into ranges of a two-part key by sorted boundaries, without a sampling pass or a driver-side list of rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 4096
LEAST = -(2**63)


def range_column(df: DataFrame, k1: str, k2: str, bounds: list[tuple[int, int]], name: str) -> DataFrame:
    """``df`` with the int column ``name``: how many of the sorted ``bounds`` are at most (k1, k2).

    The first key selects one of CELLS equal cells by arithmetic; a table of CELLS rows says how many bounds lie
    in lower cells and which lie inside. Only those are compared.
    """
    lo, hi = float(min((b[0] for b in bounds), default=0)), float(max((b[0] for b in bounds), default=1))
    span = (hi - lo) or 1.0

    def cell_of(v: float) -> int:
        return int(min(CELLS - 1.0, max(0.0, (v - lo) / span * CELLS)))

    inside: list[list[dict]] = [[] for _ in range(CELLS)]
    for a, b in bounds:
        inside[cell_of(float(a))].append({"a": a, "b": b})
    rows, below = [], 0
    for k, held in enumerate(inside):
        rows.append({"cell": k, "below": below, "held": held})
        below += len(held)
    # CELLS rows and the bounds: the size does not depend on the input
    cells = df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<cell:int,below:int,held:array<struct<a:bigint,b:bigint>>>>")))
    cells = cells.select(F.col("cell").alias("_cell"), F.col("below").alias("_below"), F.col("held").alias("_held"))
    cell: Column = F.least(F.lit(CELLS - 1.0), F.greatest(F.lit(0.0), (F.col(k1).cast("double") - F.lit(lo)) / F.lit(span) * F.lit(float(CELLS)))).cast("int")
    dealt = df.withColumn("_cell", cell).join(F.broadcast(cells), "_cell")
    key = F.struct(F.col(k1).alias("a"), F.col(k2).alias("b"))
    return dealt.withColumn(name, F.col("_below") + F.size(F.filter("_held", lambda b: b <= key))).drop("_cell", "_below", "_held")
