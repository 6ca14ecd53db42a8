"""Normalising, scoring and diversifying web sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_url, contains_any, title_key
from .merge import first_by


@dataclass(frozen=True)
class Policy:
    """Weights and word lists of a source score; the defaults are the balanced profile."""

    terms: Sequence[str] = ()
    official: Sequence[str] = ()
    off_topic: Sequence[str] = ()
    law_text: Sequence[str] = ()
    # fixed values: words that speak for a decision's text
    decision: Sequence[str] = ("entscheidung", "entscheidungen", "entscheid", "beschluss", "urteilstext", "urteil", "aktenzeichen", "ecli", "revision")
    court: Sequence[str] = ("bverwg", "bverfg", "bgh", "eugh", "egmr", "ovg", "verwaltungsgericht", "vg ")
    buckets: Sequence[tuple[str, Sequence[str]]] = ()
    top_buckets: Sequence[str] = ("bverwg", "bverfg")
    off_topic_penalty: int = 80
    law_text_penalty: int = 220
    undated_penalty: int = 0
    recency_years: int = 6


#: Penalties of the three profiles: off topic, law text, undated.
PROFILES = {"balanced": (80, 220, 0), "strict": (220, 340, 30), "broad": (35, 130, 0)}


@dataclass(frozen=True)
class Scorer:
    """A search engine's own score: words that count once or each, penalties, and a bonus for recent years."""

    once: Sequence[tuple[Sequence[str], int]] = ()
    each: Sequence[tuple[Sequence[str], int]] = ()
    unless: Sequence[tuple[Sequence[str], int]] = ()
    pdf: int = 0
    since: int | None = None
    per_year: int = 0


def engine_score(url: Column, text: Column, scorer: Scorer, as_of_year: int) -> Column:
    """The sum of a scorer's weights for one source: ``once`` if any word is in the text, ``each`` a word, ``unless`` if none is there, and
    ``per_year`` for every year of the decision after ``since``. ``text`` is lower case and holds the URL."""
    total = F.when(F.contains(F.lower(url), F.lit(".pdf")), scorer.pdf).otherwise(0)
    for words, weight in scorer.once:
        total = total + F.when(contains_any(text, words), weight).otherwise(0)
    for words, weight in scorer.each:
        total = total + _count(text, words, weight)
    for words, weight in scorer.unless:
        total = total + F.when(contains_any(text, words), 0).otherwise(weight)
    if scorer.since is not None:
        total = total + F.greatest(F.lit(0), F.coalesce(decision_year(text, as_of_year), F.lit(0)) - scorer.since) * scorer.per_year
    return total


def merge_engines(lists: Sequence[DataFrame], url: str, position: str) -> DataFrame:
    """The results of several engines in one list: each canonical URL once, from the first engine that has it, with ``engine`` and ``engines`` (how many had it)."""
    tagged = [df.withColumn("engine", F.lit(i)) for i, df in enumerate(lists)]
    every = tagged[0]
    for more in tagged[1:]:
        every = every.unionByName(more)
    every = every.withColumn("_key", canonical_url(F.col(url))).where("_key <> ''")
    kept = every.groupBy("_key").agg(F.min_by(F.struct(*every.columns), F.struct("engine", F.col(position), F.col(url))).alias("_r"), F.count_distinct("engine").alias("engines"))
    return kept.select("_r.*", "engines").drop("_key")


def blob(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns)))


def decision_year(text: Column, as_of_year: int) -> Column:
    """The latest year of a full date, else the latest bare year up to next year, else the latest of all, else 0."""
    dated = F.regexp_extract_all(text, F.lit(r"((?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2})"), F.lit(1))
    years = F.transform(dated, lambda x: F.regexp_extract(x, "((?:19|20)[0-9]{2})", 1).cast("int"))
    bare = F.transform(F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9A-Za-z_])((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda x: x.cast("int"))
    near = F.filter(bare, lambda y: y <= as_of_year + 1)
    return F.coalesce(F.array_max(years), F.array_max(near), F.array_max(bare), F.lit(0))


def bucket(text: Column, buckets: Sequence[tuple[str, Sequence[str]]]) -> Column:
    out: Column = F.lit("other")
    for name, tokens in reversed(buckets):
        out = F.when(contains_any(text, tokens), F.lit(name)).otherwise(out)
    return out


def _count(text: Column, tokens: Sequence[str], each: int) -> Column:
    out = F.lit(0)
    for t in tokens:
        out = out + F.when(text.contains(t), each).otherwise(0)
    return out


def dedupe(sources: DataFrame, url: str, title: str, position: str) -> DataFrame:
    """The first of the sources that share canonical URL and title; those without a URL go."""
    keyed = sources.withColumn("_u", canonical_url(F.col(url))).where("_u <> ''").withColumn("_t", title_key(F.col(title)))
    return first_by(keyed, ["_u", "_t"], [F.col(position)]).drop("_u", "_t")


def ranked(sources: DataFrame, policy: Policy, as_of_year: int, groups: list[str], position: str, limit: int = 40) -> tuple[DataFrame, DataFrame]:
    """Sources with a URL, deduplicated, scored, diversified and cut to ``limit`` for each of ``groups``; and how many were left after each step.

    ``sources`` has ``groups``, url, title, description and a position. The second frame has input_count, normalized_count,
    deduped_count, filtered_count and reranked_count for each group.
    """
    normal = sources.withColumn("_u", canonical_url(F.col("url"))).where("_u <> ''").withColumn("_t", title_key(F.col("title")))
    once = first_by(normal, [*groups, "_u", "_t"], [F.col(position)])
    best = diversify(score(once, policy, as_of_year), policy, groups, "url").where(F.col("place") <= limit).drop("_u", "_t")
    # one pass over the sources; only keys are counted
    counts = sources.withColumn("_u", canonical_url(F.col("url"))).groupBy(*groups, "_u", title_key(F.col("title")).alias("_t")).agg(F.count(F.lit(1)).alias("n"))
    there = F.col("_u") != ""
    counts = counts.groupBy(*groups).agg(F.sum("n").alias("input_count"), F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("normalized_count"), F.count(F.when(there, 1)).alias("deduped_count"))
    kept = F.least(F.col("deduped_count"), F.lit(limit))
    return best, counts.withColumn("filtered_count", F.col("input_count") - kept).withColumn("reranked_count", kept)


def score(sources: DataFrame, policy: Policy, as_of_year: int, url: str = "url", title: str = "title", description: str = "description") -> DataFrame:
    """Adds score, recency, year and bucket."""
    b = blob(url, title, description)
    year = decision_year(b, as_of_year)
    total = _count(b, policy.terms, 25) + F.when(contains_any(b, policy.official), 65).otherwise(0)
    total = total - F.when(contains_any(b, policy.off_topic), policy.off_topic_penalty).otherwise(0) - F.when(contains_any(b, policy.law_text), policy.law_text_penalty).otherwise(0)
    total = total + _count(b, policy.decision, 10) + F.when(b.contains("/entscheid") | b.contains("/urteil"), 10).otherwise(0)
    total = total + F.least(_count(b, policy.court, 8), F.lit(24)) + F.when(F.lower(url).contains(".pdf"), 6).otherwise(0)
    total = total - F.when(year == 0, policy.undated_penalty).otherwise(0)
    recency = F.greatest(F.lit(0), year - (as_of_year - max(1, policy.recency_years))) + F.when(year >= as_of_year, 8).otherwise(0)
    return sources.withColumns({"score": total, "year": year, "recency": F.when(year > 0, recency).otherwise(0), "bucket": bucket(b, policy.buckets)})


def diversify(scored: DataFrame, policy: Policy, groups: list[str], tie: str) -> DataFrame:
    """Repeats of one bucket lose points: 44 a repeat for the top buckets, 28 from the third of the others; then a new order."""
    order = [F.col("score").desc(), F.col("recency").desc(), F.col(tie).desc()]
    n = F.row_number().over(Window.partitionBy(*groups, "bucket").orderBy(*order)) - 1
    other = F.max(F.when(~F.col("bucket").isin("other", policy.top_buckets[0]), 1).otherwise(0)).over(Window.partitionBy(*groups))
    free = F.when(other == 1, 1).otherwise(2)
    top = F.col("bucket").isin(*policy.top_buckets)
    loss = F.when(top & (F.col("_n") >= F.col("_free")), 44 * (F.col("_n") - F.col("_free") + 1)).when((F.col("bucket") != "other") & (F.col("_n") >= 2), 28 * (F.col("_n") - 1)).otherwise(0)
    held = scored.withColumn("_n", n).withColumn("_free", free).withColumn("adjusted", F.col("score") - loss)
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.col("adjusted").desc(), F.col("recency").desc(), F.col(tie).desc()))
    return held.withColumn("place", place).drop("_n", "_free")
