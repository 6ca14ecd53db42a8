"""Citations, quotations and facts checked against page texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import spread
from .beside import WIDE, by_document, parted


def normal(c: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def status(hit: Column, other: Column, has_text: Column) -> Column:
    """no_text, verified, other_page, ambiguous or not_found from the number of hits on the cited pages and elsewhere."""
    return F.when(~has_text, "no_text").when(hit > 0, "verified").when(other == 1, "other_page").when(other > 1, "ambiguous").otherwise("not_found")


# What counts as a hard anchor of a claim: dates, years, decimal and other numbers.
ANCHORS = (r"\b\d{1,2}\.\d{1,2}\.\d{2,4}\b", r"\b\d{4}\b", r"\b\d+[.,]\d+\b", r"\b\d+\b")


def anchors(claim: Column) -> Column:
    """The hard anchors of a claim, each once, in the form in which pages are compared."""
    found = F.concat(*(F.regexp_extract_all(F.coalesce(claim, F.lit("")), F.lit(p), F.lit(0)) for p in ANCHORS))
    return F.filter(F.transform(F.array_distinct(found), normal), lambda a: a != "")


def anchored(claim: Column, page: Column, stop: Sequence[str] = ()) -> Column:
    """Whether a page can be what a claim cites, by its words and hard anchors (struct: match, words, of_words, anchors, of_anchors).

    Words have five letters at least and are no stop words. A word of seven or more also counts if the page has one with the same five
    first letters that is alike by 0.78; only words left over and such candidates are sent to Python. With anchors: two thirds of them, two words and a quarter
    of the words; or two anchors and a fifth of the words. Without: four words and 55 %, or, of eight words at most, three and
    38 % with one of twelve letters.
    """
    plain = normal(page)
    on_page = F.array_distinct(F.split(plain, " "))
    words = _content(claim, stop)
    rest = F.filter(F.array_except(words, on_page), lambda w: F.length(w) >= 7)
    heads = F.transform(rest, lambda w: F.substring(w, 1, 5))
    near = F.filter(on_page, lambda w: (F.length(w) >= 7) & F.array_contains(heads, F.substring(w, 1, 5)))
    hit = F.concat(F.array_intersect(words, on_page), _alike(rest, near))
    hard = anchors(claim)
    n, of = F.size(hit), F.size(words)
    hard_n, hard_of = F.size(F.filter(hard, lambda a: F.contains(plain, a))), F.size(hard)
    part, hard_part = n / F.greatest(of, F.lit(1)), hard_n / F.greatest(hard_of, F.lit(1))
    by_anchor = ((hard_part >= 0.67) & (n >= 2) & (part >= 0.25)) | ((hard_n >= 2) & (part >= 0.2))
    by_words = ((n >= 4) & (part >= 0.55)) | ((n >= 3) & (of <= 8) & (part >= 0.38) & F.exists(hit, lambda w: F.length(w) >= 12))
    match = (of > 0) & (plain != "") & F.when(hard_of > 0, by_anchor).otherwise(by_words)
    return F.struct(match.alias("match"), n.alias("words"), of.alias("of_words"), hard_n.alias("anchors"), hard_of.alias("of_anchors"))


def _content(claim: Column, stop: Sequence[str]) -> Column:
    """The distinct words of a claim that say something."""
    return F.array_distinct(F.filter(F.split(normal(claim), " "), lambda w: (F.length(w) >= 5) & ~w.isin(*stop) if stop else F.length(w) >= 5))


def anchored_pairs(claims: DataFrame, pages: DataFrame, within: str, claim_id: str, page_id: str, claim: str, page: str, stop: Sequence[str] = (), wide: int = WIDE) -> DataFrame:
    """(within, claim_id, page_id, by) for the pages of the same document that pass ``anchored``.

    Claims and pages are prepared once and meet by document in one task. The pairs of documents with more than ``wide`` of either are dealt over
    tasks: see :func:`_anchored_by_joins`.
    """
    near, far = parted(claims.select(within, claim_id, claim), pages.select(within, page_id, page), within, wide)
    hard = F.when(F.col(claim).rlike("[0-9]"), anchors(F.col(claim))).otherwise(F.array().cast("array<string>"))  # each has a digit
    said = near[0].select(F.col(within).alias("doc"), F.col(claim_id).alias("id"), _content(F.col(claim), stop).alias("words"), hard.alias("hard")).where("id is not null")
    held = near[1].select(F.col(within).alias("doc"), F.col(page_id).alias("page"), normal(F.col(page)).alias("plain")).where("page is not null and plain <> ''")
    counts = ["words", "of_words", "anchors", "of_anchors"]
    fields = [T.StructField("id", claims.schema[claim_id].dataType), T.StructField("page", pages.schema[page_id].dataType), *(T.StructField(c, T.IntegerType()) for c in counts)]
    found = by_document(said, held, _anchored_rows, fields)
    out = found.select(F.col("doc").alias(within), F.col("id").alias(claim_id), F.col("page").alias(page_id), F.struct(F.lit(True).alias("match"), *counts).alias("by"))
    return out if far is None else out.unionByName(_anchored_by_joins(*far, within, claim_id, page_id, claim, page, stop))


@lru_cache(maxsize=1 << 17)
def alike(word: str, other: str) -> bool:
    """Whether a word resembles another one by 0.78."""
    return 2 * min(len(word), len(other)) >= 0.78 * (len(word) + len(other)) and SequenceMatcher(None, word, other).ratio() >= 0.78


def _anchored_rows(claims: list[tuple], pages: list[tuple]) -> Iterator[tuple]:
    """(id, page, words, of_words, anchors, of_anchors) of the pairs that pass ``anchored``, from (id, words, anchors) and (page, plain text)."""
    index: dict[str, dict[int, list[str]]] = {}  # words by their five first letters and page
    for k, (_, plain) in enumerate(pages):
        for w in set(plain.split(" ")):
            if len(w) >= 5:
                index.setdefault(w[:5], {}).setdefault(k, []).append(w)
    for claim, said, hard in claims:
        of, hard_of = len(said), len(hard)
        begun = [index.get(w[:5], {}) for w in said]
        count = [0] * len(pages)
        for there in begun:
            for k in there:
                count[k] += 1
        for k, most in enumerate(count):
            # a word can only match one with the same five first letters
            if not (most and (most / of >= 0.2 if hard_of else most >= 3 and most / of >= 0.38)):
                continue
            page, plain = pages[k]
            hit = [w for w, there in zip(said, begun, strict=True) if k in there and (w in there[k] or (len(w) >= 7 and any(len(c) >= 7 and alike(w, c) for c in there[k])))]
            n, part, hard_n = len(hit), len(hit) / of, sum(a in plain for a in hard)
            if hard_of:
                match = (hard_n / hard_of >= 0.67 and n >= 2 and part >= 0.25) or (hard_n >= 2 and part >= 0.2)
            else:
                match = (n >= 4 and part >= 0.55) or (n >= 3 and of <= 8 and part >= 0.38 and any(len(w) >= 12 for w in hit))
            if match:
                yield claim, page, n, of, hard_n, hard_of


def _anchored_by_joins(claims: DataFrame, pages: DataFrame, within: str, claim_id: str, page_id: str, claim: str, page: str, stop: Sequence[str] = ()) -> DataFrame:
    """:func:`anchored_pairs` of documents of any width.

    A word can only match one with the same five first letters, so ids are joined on these and counted first: pairs with fewer shared
    beginnings than the rules need words cannot match and are never compared. Texts are fetched for the rest.
    """
    said = claims.select(within, claim_id, _content(F.col(claim), stop).alias("_w"), (F.size(anchors(F.col(claim))) > 0).alias("_hard"))
    words = said.select(within, claim_id, "_hard", F.size("_w").alias("_of"), F.explode("_w").alias("_word")).withColumn("_head", F.substring("_word", 1, 5))
    heads = F.array_distinct(F.transform(F.filter(F.split(normal(F.col(page)), " "), lambda w: F.length(w) >= 5), lambda w: F.substring(w, 1, 5)))
    shared = words.join(pages.select(within, page_id, F.explode(heads).alias("_head")), [within, "_head"])
    counted = shared.groupBy(within, claim_id, page_id, "_hard", "_of").agg(F.count(F.lit(1)).alias("_n"))
    # the least that any of the rules asks for
    part = F.col("_n") / F.col("_of")
    maybe = counted.where(F.when(F.col("_hard"), part >= 0.2).otherwise((F.col("_n") >= 3) & (part >= 0.38)))
    met = maybe.select(within, claim_id, page_id).join(claims.select(within, claim_id, claim), [within, claim_id])
    both = spread(met, within, page_id).join(spread(pages.select(within, page_id, page), within, page_id).hint("merge"), [within, page_id])
    return both.withColumn("by", anchored(F.col(claim), F.col(page), stop)).where("by.match").select(within, claim_id, page_id, "by")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _alike(words: pd.Series, near: pd.Series) -> pd.Series:
    """The words that one of the candidates resembles."""
    like = lambda w, c: w[:5] == c[:5] and SequenceMatcher(None, w, c).ratio() >= 0.78
    return pd.Series([None if ws is None else [w for w in ws if any(like(w, c) for c in cs)] for ws, cs in zip(words, near, strict=True)])


def contained(docs: DataFrame, passages: DataFrame, key: str, text: str, item: str, passage: str) -> DataFrame:
    """(key, item) for passages that stand in a text as they are.

    A passage's first and last word may be parts of words, so candidates share its inner words, the first three at most; only ids
    go through that join, and texts are fetched for candidates. Passages of one or two words have no inner word and are looked for in all texts.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    inner = passages.withColumn("_w", words(F.col(passage))).withColumn("_k", F.least(F.size("_w") - 2, F.lit(3)))
    inner = inner.where(F.length(passage) > 0).withColumn("_k", F.greatest("_k", F.lit(0)))
    docs = docs.select(key, text)
    out = []
    for k in sorted(r[0] for r in inner.select("_k").distinct().collect()):  # 0 to 3
        own = inner.where(F.col("_k") == k)
        if k == 0:
            out.append(docs.join(own.select(item, passage), F.col(text).contains(F.col(passage))).select(key, item))
            continue
        mine = own.select(item, F.xxhash64(*(F.get("_w", F.lit(n + 1)) for n in range(k))).alias("_h"))
        runs = F.col("_w")
        if k > 1:  # words side by side, without the array itself inside a lambda
            runs = F.arrays_zip(*(F.slice("_w", F.lit(n + 1), F.greatest(F.size("_w") - k + 1, F.lit(0))).alias(f"w{n}") for n in range(k)))
        hashed = F.transform(runs, (lambda x: F.xxhash64(x)) if k == 1 else (lambda x: F.xxhash64(*(x[f"w{n}"] for n in range(k)))))
        each = docs.select(key, words(F.col(text)).alias("_w")).select(key, F.explode(F.array_distinct(hashed)).alias("_h"))
        near = each.join(mine, "_h").select(key, item).distinct()
        out.append(docs.join(near, key).join(passages.select(item, passage), item).where(F.col(text).contains(F.col(passage))).select(key, item))
    return reduce(DataFrame.union, out).distinct() if out else docs.select(key).limit(0).join(passages.select(item), F.lit(False))


def missing_facts(draft: Column, corpus: Column) -> Column:
    """Facts of a draft that the corpus does not have."""
    return F.array_except(draft, corpus)
