"""Case facets against decisions: overlap joins, fit, risk and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold


def overlap_pairs(cases: DataFrame, entries: DataFrame, case_key: str, entry_key: str, tokens: str) -> DataFrame:
    """(case, entry) with at least one token in common: an equi join on exploded tokens in place of a comparison of all."""
    a = cases.select(case_key, F.explode(F.array_distinct(tokens)).alias("_t"))
    b = entries.select(entry_key, F.explode(F.array_distinct(tokens)).alias("_t"))
    return a.join(b, "_t").groupBy(case_key, entry_key).agg(F.count(F.lit(1)).alias("shared"))


def fit(country_hit: Column, norm_share: Column, theme_share: Column, weight: Column, age_days: Column) -> Column:
    """0.35 country + 0.30 norms + 0.15 themes + 0.05 per instance step (3 at most) + up to 0.08 for recency over five years; 1 at most, 3 places."""
    recent = F.greatest(F.lit(0.0), 0.08 * (1 - age_days / 1825))
    parts = F.when(country_hit, 0.35).otherwise(0.0) + 0.30 * norm_share + 0.15 * theme_share + 0.05 * F.least(weight, F.lit(3)) + F.coalesce(recent, F.lit(0.0))
    return F.round(F.least(parts, F.lit(1.0)), 3)


#: Sections of the asylum act by the question that they settle; articles of two regulations name the same questions.
ASYLUM_ACT = {
    "geas:fluechtling": ("3", "3a", "3b", "3c", "3d", "3e"),
    "geas:subsidiaer": ("4",),
    "geas:unzulaessig": ("29", "29a"),
    "geas:offensichtlich": ("30", "30a"),
    "geas:ou-verfahren": ("36",),
}


def bridge_tokens(norm: Column) -> Column:
    """Array of the questions that a norm settles, in whichever act it stands; empty for norms that no act has moved.

    A regulation cited without an article stands for all of its questions.
    """
    n = fold(F.coalesce(norm, F.lit("")))
    section, text = F.regexp_extract(n, r"§\s*(\d+[a-z]?)", 1), F.regexp_extract(n, r"art(?:ikel|\.)?\s*(\d+)", 1)
    named = text != ""
    article = F.when(named, text.cast("int"))
    some = lambda *names: F.array(*map(F.lit, names))
    none = F.array().cast("array<string>")
    act = none
    for token, sections in ASYLUM_ACT.items():
        act = F.when(section.isin(*sections), some(token)).otherwise(act)
    status = F.when(~named, some("geas:fluechtling", "geas:subsidiaer")).when(article.between(15, 17), some("geas:subsidiaer")).otherwise(some("geas:fluechtling"))
    procedure = F.when(~named, some("geas:unzulaessig", "geas:offensichtlich", "geas:ou-verfahren")).when(article == 38, some("geas:unzulaessig"))
    procedure = procedure.when(article.isin(39, 42), some("geas:offensichtlich")).when(article.isin(67, 68), some("geas:ou-verfahren")).otherwise(none)
    dublin = n.contains("dublin") | n.contains("604/2013") | n.contains("2024/1351")
    return F.when(n.contains("asylg"), act).when(n.contains("2024/1347"), status).when(n.contains("2024/1348"), procedure).when(dublin, some("geas:zustaendigkeit")).otherwise(none)


def law_stale(decided: Column, norms: Column, cutoff: Column) -> Column:
    """Whether a decision predates the change of law and rests on a norm that it moved."""
    return F.coalesce((decided < cutoff) & F.exists(norms, lambda x: F.size(bridge_tokens(x)) > 0), F.lit(False))


def norm_share(wanted: Column, have: Column) -> Column:
    """Part of the wanted norms, repeats counted, that are there by name or by a question that they settle; 0 if nothing is wanted."""
    names = F.transform(have, fold)
    asked = F.flatten(F.transform(have, bridge_tokens))
    hits = F.size(F.filter(wanted, lambda w: F.array_contains(names, fold(w)) | F.arrays_overlap(bridge_tokens(w), asked)))
    return F.when(F.size(wanted) > 0, hits / F.size(wanted)).otherwise(0.0)


def share(wanted: Column, have: Column) -> Column:
    """Part of the distinct wanted tokens that are there, compared folded; 0 if nothing is wanted."""
    own = F.array_distinct(F.transform(wanted, fold))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, F.transform(have, fold))) / F.size(own)).otherwise(0.0)


def mismatch(axis: str, ours: Column, theirs: Column) -> Column:
    """Whether two profiles differ on an axis; an age may differ by ten years, texts are compared folded, a missing value never differs."""
    differs = F.abs(ours - theirs) > 10 if axis == "age" else fold(ours.cast("string")) != fold(theirs.cast("string"))
    return F.coalesce(differs, F.lit(False))


def risk(compared: Column, mismatches: Column, carrying: Column) -> Column:
    return F.when(compared == 0, "ungeprueft").when(carrying > 0, "hoch").when(mismatches > 0, "moeglich").otherwise("niedrig")


def coverage(found: Column, most: int, research: Column) -> Column:
    """Share of the wanted decisions that are there, and a fifth more with recent research; 1 at most."""
    return F.least(F.lit(1.0), F.least(F.lit(1.0), found / float(max(1, most))) + F.when(research > 0, 0.2).otherwise(0.0))


def freshness(found: Column, least: int, age_days: Column, refresh_days: Column) -> Column:
    return F.when(found == 0, "missing").when(found < least, "thin").when(age_days > refresh_days, "stale").otherwise("fresh")


def closure(alias: DataFrame, hops: int = 8) -> DataFrame:
    """(alias, target) followed through chains of up to ``hops``: a small dimension table, joined to itself once a hop."""
    now = alias.select("alias", "target")
    step = alias.select(F.col("alias").alias("target"), F.col("target").alias("_next"))
    for _ in range(hops - 1):
        now = now.join(step, "target", "left").select("alias", F.coalesce("_next", "target").alias("target"))
    return now


def canonical(rows: DataFrame, vocab: DataFrame, keys: list[str], terms: str) -> DataFrame:
    """Per key the canonical names of the terms in first-seen order; unknown terms are left out. ``vocab`` has (alias, target)."""
    each = rows.select(*keys, F.posexplode(terms).alias("_p", "_t")).withColumn("alias", F.lower(F.trim("_t"))).join(vocab, "alias")
    first = each.groupBy(*keys, "target").agg(F.min("_p").alias("_p"))
    names = F.transform(F.sort_array(F.collect_list(F.struct("_p", "target"))), lambda x: x["target"])
    return first.groupBy(*keys).agg(names.alias("names"))


def majority(rows: DataFrame, keys: list[str], term: str, position: str, most: int = 12) -> DataFrame:
    """Per key the most frequent terms, ties by first sight, ``most`` at most, with their place."""
    from .merge import top_by

    counted = rows.groupBy(*keys, term).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    return top_by(counted, keys, [F.col("n").desc(), F.col("first"), F.col(term)], most, "place")
