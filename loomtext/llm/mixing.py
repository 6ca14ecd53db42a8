"""Mixing sources to target weights, in DataFrame operations only.

Within a source, texts are ordered by a hash of the id. Sums of words per source and hash prefix, then prefix
sums over the prefixes, find the one prefix in which a source's budget ends; only its rows are summed one by one.
Every other row knows its share from its key alone, so texts are never moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize
from .ranges import LEAST


def _described(id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    text, ident = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`")
    return [
        F.col(f"`{source_col}`").cast("string").alias("_source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.struct(
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))).alias("key"),
            F.coalesce(ident.cast("long"), F.lit(LEAST)).alias("id"),
            F.xxhash64(text).alias("th"),
        ).alias("_at"),
    ]


def targets(totals: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """From (_source, total) to (_source, total, target): a row for each source.

    Weights repeat over the sources in code point order, null last. The shares of ``share`` of all words stop at
    ``most`` times a source's words and the excess goes to the others by weight: target = least(most * total,
    level * weight) for one level, which is found by prefix sums over the sources in the order in which they reach their stop.
    """
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    held = totals.withColumn("w", weight).withColumn("stop", F.lit(float(most)) * F.col("total")).withColumn("ratio", F.col("stop") / F.col("w"))
    before = Window.orderBy("ratio", F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.lit(float(share)) * F.sum("total").over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    held = held.withColumn("level", level)
    # the first source that does not reach its stop settles the level
    found = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(every)
    return held.select("_source", "total", F.least(F.col("stop"), F.coalesce(found, F.col("ratio")) * F.col("w")).alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11
) -> DataFrame:
    """All columns of ``docs``, then size, source_size, target and taken.

    size is the number of words (runs without ASCII white space; null: 0). A source's budget, its target
    rounded down, is filled by whole passes over the source and then by texts in hash order, the last in part:
    ``taken`` is the number of words that the mix takes of a row, repeats counted, and adds up to the budget.
    Rows that are equal in id and text at the cut take equal parts of what is left, rounded down. A null source
    is one source, the last. Texts without words take nothing. Columns called like a result are replaced by it;
    an empty table gives an empty result. The same table gives the same mix.
    """
    light = materialize(docs.select(*_described(id_col, text_col, source_col, seed)), "light")
    named = F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit("")).alias("_name")
    light = light.select(named, "_source", "_size", "_at", F.conv(F.substring("_at.key", 1, 3), 16, 10).cast("int").alias("b"))
    sums = light.groupBy("_name", "b").agg(F.sum("_size").alias("s"), F.first("_source").alias("_source"))
    totals = light.groupBy("_name").agg(F.sum("_size").alias("total"), F.max("_source").alias("_source"))
    goal = targets(totals.drop("_name"), weights, share, most).withColumn("_name", named)
    passes = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("long")
    goal = goal.withColumn("passes", passes).withColumn("rest", F.floor("target").cast("long") - F.col("passes") * F.col("total"))
    # the prefix in which the budget of the last pass ends
    run = Window.partitionBy("_name").orderBy("b")
    ends = sums.withColumn("until", F.sum("s").over(run)).join(goal.select("_name", "rest"), "_name").where("s > 0 and until - s <= rest and rest < until")
    ends = ends.select("_name", "b", (F.col("rest") - (F.col("until") - F.col("s"))).alias("rest"))
    inside = light.join(ends, ["_name", "b"]).groupBy("_name", "rest", "_at").agg(F.sum("_size").alias("s"), F.count(F.lit(1)).alias("c"))
    row = inside.withColumn("until", F.sum("s").over(Window.partitionBy("_name").orderBy("_at")))
    cut = row.where("s > 0 and until - s <= rest and rest < until").select("_name", F.col("_at").alias("cut"), F.floor((F.col("rest") - (F.col("until") - F.col("s"))) / F.col("c")).cast("long").alias("part"))
    plan = materialize(goal.join(cut, "_name", "left").select("_name", F.col("total").alias("source_size"), "target", "passes", "cut", "part"), "plan")

    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    own = [f"_c{k}" for k in range(len(names))]
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(names, own, strict=True)), *_described(id_col, text_col, source_col, seed)).withColumn("_name", named)
    last = F.when(F.col("_at") < F.col("cut"), F.col("_size")).when(F.col("_at") == F.col("cut"), F.col("part")).otherwise(0)
    out = rows.join(plan, "_name").withColumn("taken", (F.col("passes") * F.col("_size") + F.when(F.col("cut").isNull(), 0).otherwise(last)).cast("long"))
    return out.select(*(F.col(k).alias(c) for c, k in zip(names, own, strict=True)), F.col("_size").alias("size"), "source_size", "target", "taken")
