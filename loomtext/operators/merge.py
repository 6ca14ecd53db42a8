"""Keyed merges, change detection and anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def top_by(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key with their rank; the plan limits groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def upsert(current: DataFrame, incoming: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of ``current`` replaced or joined by those of ``incoming``; of several for a key the last position wins."""
    last = first_by(incoming, [key], [F.col(position).desc()]).drop(position)
    return current.join(last.select(key), key, "left_anti").unionByName(last)


def delete(current: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return current.where(~F.coalesce(condition, F.lit(False)))


def unseen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has not been seen: resume logs, known hashes, tombstones."""
    return df.join(seen.select(*keys).distinct(), keys, "left_anti")


def first_wins(lists: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Rows of several lists, each key once: as the first list that has it says. Within a list keys are unique."""
    every = None
    for n, one in enumerate(lists):
        part = one.select(key, *columns, F.lit(n).alias("_list"))
        every = part if every is None else every.unionByName(part)
    return first_by(every, [key], [F.col("_list")]).drop("_list")


def page_aliases(pages: DataFrame, key: str, number: str, start: str, end: str) -> DataFrame:
    """``pages`` with further rows under the page numbers of the document that a segment was cut from.

    The n-th page is also page ``start`` + n - 1 if that lies in the segment (``end`` null: open) and is not a number of its own already.
    """
    n = F.row_number().over(Window.partitionBy(key).orderBy(number))
    also = pages.withColumn("_o", F.col(start) + n - 1).where(F.col("_o").isNotNull() & (F.col(end).isNull() | (F.col("_o") <= F.col(end))))
    new = also.withColumn(number, F.col("_o").cast(pages.schema[number].dataType)).drop("_o").join(pages.select(key, number), [key, number], "left_anti")
    return pages.unionByName(new)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key: new, gone, updated or unchanged."""
    b = before.select(F.col(key), F.col(value).alias("_b"), F.lit(1).alias("_hb"))
    a = after.select(F.col(key), F.col(value).alias("_a"), F.lit(1).alias("_ha"))
    state = F.when(F.col("_hb").isNull(), "new").when(F.col("_ha").isNull(), "gone").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("updated")
    return b.join(a, key, "full_outer").select(key, state.alias("state"))


def merge_intervals(df: DataFrame, keys: list[str], kind: str, start: str, end: str, gap: int = 1) -> DataFrame:
    """Intervals of one kind that overlap or lie within ``gap`` become one, in order of their start."""
    order = Window.partitionBy(*keys).orderBy(start, end, kind)
    reach = F.max(end).over(Window.partitionBy(*keys, kind).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    opens = ~(F.lag(kind).over(order).eqNullSafe(F.col(kind)) & (F.col(start) <= reach + gap))
    island = df.withColumn("_open", F.coalesce(opens, F.lit(True)).cast("int")).withColumn("_island", F.sum("_open").over(order))
    return island.groupBy(*keys, kind, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts")).drop("_island")


def untold(proposed: DataFrame, entries: DataFrame, sources: DataFrame, case: str, entry: str, title: str) -> DataFrame:
    """Proposed entries (case, title, ...) whose title the case has not produced yet, compared without case and outer blanks.

    ``sources`` (case, entry) say which case an entry of ``entries`` (entry, title) came from. Null titles are never told.
    """
    plain = F.lower(F.trim(F.col(title))).alias("_t")
    told = sources.select(case, entry).join(entries.select(entry, plain), entry).select(case, "_t").distinct()
    return proposed.withColumn("_t", plain).join(told, [case, "_t"], "left_anti").drop("_t")
