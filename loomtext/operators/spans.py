"""Typed places in texts: found in parts of long texts, freed of overlaps, widened to whole words, and replaced.

A text is cut into parts that are rows of their own, so that many tasks work on a long one. A part has a margin on both sides, in
which patterns may look around and hits may end; a hit belongs to the part in whose core it begins, so hits in margins are not counted twice.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.jobs import folded


def text_parts(df: DataFrame, key: str, text: str, size: int = 100_000, margin: int = 1_000) -> DataFrame:
    """(key, at, core, part): each text in parts of ``size`` characters, each with up to ``margin`` more on both sides.

    ``at`` is where the part begins in the text, ``core`` where its own characters begin in it. A null text has no parts, an empty one has one.
    A margin is at most as long as a part.
    """
    if margin > size:
        raise ValueError("a margin is taken from one neighbour: it cannot be longer than a part")
    # one pass cuts all cores; a margin is taken from the neighbours
    cores = F.when(F.col(text) == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0)))
    each = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.arrays_zip(cores.alias("core"), F.concat(F.array(F.lit("")), cores).alias("before"), F.concat(F.slice(cores, 2, F.greatest(F.size(cores) - 1, F.lit(0))), F.array(F.lit(""))).alias("after"))).alias("_n", "_p"))
    before, after = F.right(F.coalesce("_p.before", F.lit("")), F.lit(margin)), F.left(F.coalesce("_p.after", F.lit("")), F.lit(margin))
    each = each.where(F.col("_p.core").isNotNull())
    return each.select(key, (F.col("_n").cast("long") * size - F.length(before)).alias("at"), F.length(before).alias("core"), F.concat(before, "_p.core", after).alias("part"), F.length("_p.core").alias("width"))


def found(df: DataFrame, key: str, text: str, rules: Sequence[tuple[str, str, float]], size: int = 100_000, margin: int = 1_000) -> DataFrame:
    """(key, type, start, end, value, score): where each rule (type, pattern, score) finds something; group 1 is the place, if there is one.

    Patterns are Python's. What they match and look at has to fit the margin; then the result does not depend on how texts are cut, for patterns whose matches are told
    by their edges. Empty matches are none.
    """
    listed = [(t, p, s) for t, p, s in rules]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(t, re.compile(p), s) for t, p, s in listed]
        for batch in batches:
            rows = []
            for k, at, core, part, width in batch[[key, "at", "core", "part", "width"]].itertuples(index=False, name=None):
                for kind, pattern, score in compiled:
                    for m in pattern.finditer(part):
                        group = 1 if pattern.groups and m[1] is not None else 0
                        start, end = m.span(group)
                        if end > start and core <= start < core + width:
                            rows.append((k, kind, at + start, at + end, m[group], score))
            yield pd.DataFrame(rows, columns=[key, "type", "start", "end", "value", "score"])

    kind = df.schema[key].dataType.simpleString()
    return text_parts(df, key, text, size, margin).mapInPandas(run, f"{key} {kind}, type string, start long, end long, value string, score double")


def disjoint(spans: DataFrame, key: str, types: Sequence[str]) -> DataFrame:
    """Of spans that overlap the longest, of equally long ones that of the type named first, then the first in the text; types that are not named come last.

    Spans of a key are taken in that order, one at a time, so a text's task holds the spans that are kept. Empty and null spans go, equal ones stay once.
    """
    rank = F.array_position(F.array(*map(F.lit, types)), F.col("type")) if types else F.lit(0)
    ranked = spans.where(F.col("end") > F.col("start")).withColumn("rank_", F.when(rank > 0, rank).otherwise(len(types) + 1)).withColumn("less_", F.col("start") - F.col("end"))
    columns = [c for c in spans.columns if c != key]

    def step(taken: list, row) -> list[tuple]:
        place = (row.start, row.end)
        k = bisect_left(taken, place)
        if (k and taken[k - 1][1] > row.start) or (k < len(taken) and taken[k][0] < row.end):
            return []
        taken.insert(k, place)
        return [tuple(getattr(row, c) for c in (key, *columns))]

    schema = ", ".join(f"{c} {spans.schema[c].dataType.simpleString()}" for c in (key, *columns))
    return folded(ranked, key, ["less_", "rank_", "start", "type"], list, step, None, schema)


def exclusive_types(spans: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Spans whose value, compared without case and punctuation, belongs to their type: that of the best score in the text, of equal ones the first by name."""
    plain = F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))
    best = spans.groupBy(key, plain.alias("plain_"), "type").agg(F.max("score").alias("score_"))
    one = best.withColumn("n_", F.row_number().over(Window.partitionBy(key, "plain_").orderBy(F.desc("score_"), "type"))).where("n_ = 1").select(key, "plain_", "type")
    return spans.withColumn("plain_", plain).join(one, [key, "plain_", "type"], "left_semi").drop("plain_")


_WORD = re.compile(r"[\w'’-]")


def _widened(text: str, start: int, end: int) -> tuple[int, int]:
    while start > 0 and _WORD.match(text[start - 1]) and _WORD.match(text[start]):
        start -= 1
    while end < len(text) and _WORD.match(text[end]) and _WORD.match(text[end - 1]):
        end += 1
    return start, end


def replaced(df: DataFrame, spans: DataFrame, key: str, text: str, tokens: dict[str, str], widen: Sequence[str] = (), out: str = "redacted") -> DataFrame:
    """``df`` with ``out``: each text with its spans replaced by the token of their type, from the right, and ``n_spans``, how many.

    Spans of the types in ``widen`` are widened to whole words before. Spans may not overlap; of two that do after widening the later is joined to the
    one before and goes with it. Spans of other types and beyond the text stay. A text without spans is unchanged; keys are unique.
    """
    lists = spans.where(F.col("type").isin(*tokens)).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "type"))).alias("spans_"))

    @F.pandas_udf("struct<text string, n long>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, places in parts:
            rows = []
            for value, own in zip(texts, places, strict=True):
                if value is None or own is None:
                    rows.append((value, 0))
                    continue
                kept: list[list] = []
                for s in own:
                    start, end, kind = s["start"], s["end"], s["type"]
                    if not 0 <= start < end <= len(value):
                        continue
                    if kind in widen:
                        start, end = _widened(value, start, end)
                    if kept and start < kept[-1][1]:
                        kept[-1][1] = max(kept[-1][1], end)
                    else:
                        kept.append([start, end, kind])
                pieces, at = [], len(value)
                for start, end, kind in reversed(kept):
                    pieces += [value[end:at], tokens[kind]]
                    at = start
                rows.append((value[:at] + "".join(reversed(pieces)), len(kept)))
            yield pd.DataFrame(rows, columns=["text", "n"])

    both = df.join(lists, key, "left").withColumn("done_", run(text, "spans_"))
    return both.withColumn(out, F.col("done_.text")).withColumn("n_spans", F.col("done_.n")).drop("spans_", "done_")
