"""Claims checked against the pages they cite and the other pages of their document.

Evidence of a page is, in this order: the claim stands there as it is; its words and hard anchors are there; a window of words
resembles it. A claim is compared with the text of its cited pages, once, and with those other pages only that can hold
strong evidence: they have as many of its words as any evidence needs. Claims and pages meet by document in one task; those of documents
too wide for that meet as ids through an index of the claim's rarest words, so pairs without a common word are never formed. Windows are scored from the most promising downward, by an upper bound of their
likeness from the counts of their characters, until none can beat the best.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache
from math import ceil
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut
from ..sources.tables import spread
from .beside import WIDE, by_document, parted
from .verification import ANCHORS, alike, normal

# Words that say nothing about what a claim is about.
STOP = frozenset(
    "aber alle allem allen aller alles als also am an auch auf aus bei beim bis da dadurch damit dann das dass dem den der des die dies diese diesem diesen dieser dieses doch dort durch"
    " ein eine einem einen einer eines es fuer für gegen gewesen hat hatte hatten hier im in ist kein keine keinem keinen keiner mit nach nicht noch nur oder ohne sich sie sind sowie ueber"
    " über und unter vom von vor war waren wegen weil wenn wie wird wurde wurden zu zum zur abs akte akten anlage blatt dokument seite vgl siehe kläger klaeger klägerin klaegerin beklagte"
    " bundesamt bescheid schreiben gericht vortrag vorgetragen".split()
)
#: Likeness of windows: a match, and one that is strong enough on a page that is not cited; share of a claim's words before windows are looked at.
MATCH, STRONG, GATE = 0.72, 0.82, 0.35
STATUSES = ("verified", "other_page", "ambiguous", "not_found", "no_text")


def match_text(text: str | None) -> str:
    """Without accents and case, runs of anything but a-z, 0-9 as one space."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        for c in filter(unicodedata.combining, set(text)):
            text = text.replace(c, "")
    return " ".join(re.sub(r"[^a-z0-9äöüß]+", " ", text.lower()).split())


@F.pandas_udf(T.StringType())
def match_form(texts: pd.Series) -> pd.Series:
    """:func:`match_text` as a column."""
    return texts.map(match_text)


class Evidence(NamedTuple):
    """What a page says about a claim."""

    method: str
    matched: bool
    score: float
    words: int = 0
    hard: float | None = None

    @property
    def strong(self) -> bool:
        if not self.matched:
            return False
        if self.method == "exact":
            return True
        if self.method == "window":
            return self.score >= STRONG
        return (self.hard is not None and self.hard >= 0.8 and self.words >= 2) or (self.score >= 0.98 and self.words >= 3) or (self.score >= 0.68 and self.words >= 4)

    @property
    def near(self) -> bool:
        return self.score >= {"exact": 0.34, "window": 0.34, "words": 0.2, "overlap": 0.2}.get(self.method, 2.0)


@lru_cache(maxsize=1024)
def hard_anchors(claim: str) -> list[str]:
    """Dates, years and other numbers of a claim in the form of pages, each once as it is written."""
    found = dict.fromkeys(m for p in ANCHORS for m in re.findall(p, claim))
    return [a for a in map(match_text, found) if a]


@lru_cache(maxsize=1024)
def content(plain: str) -> list[str]:
    return sorted({w for w in plain.split() if len(w) >= 5 and w not in STOP})


@lru_cache(maxsize=1024)
def significant(plain: str) -> set[str]:
    return {w for w in plain.split() if len(w) >= 4 and w not in STOP}


class Page:
    """A page's words, prepared for several claims."""

    def __init__(self, plain: str):
        self.plain, self.listed = plain, plain.split()
        self.words = set(self.listed)
        self.heads: dict[str, list[str]] = {}
        for w in self.words:
            if len(w) >= 7:
                self.heads.setdefault(w[:5], []).append(w)
        self._sums: np.ndarray | None = None

    def has(self, word: str) -> bool:
        """Whether the page has the word or, from seven letters on, one with the same beginning that resembles it."""
        return word in self.words or (len(word) >= 7 and any(alike(word, w) for w in self.heads.get(word[:5], ())))

    @property
    def sums(self) -> np.ndarray:
        """Counts of characters, by 64 kinds, before each word."""
        if self._sums is None:
            lengths = [len(w) for w in self.listed]
            at = np.repeat(np.arange(1, len(lengths) + 1), lengths) * 64 + _kinds("".join(self.listed))
            self._sums = np.bincount(at, minlength=(len(lengths) + 1) * 64).reshape(-1, 64).cumsum(axis=0, dtype=np.int32)
        return self._sums


def _kinds(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32) & 63


_BLANK = ord(" ") & 63


def best_window(plain: str, page: Page, least: float = 0.0) -> float:
    """The best likeness of a claim to a window of the page's words, if it reaches ``least``; else something below it, or 0.

    A window has four words more than the claim, eight at least, and begins at every (half the claim's words)th word, every eighth at most. Of the
    claim's significant words it holds two at least, if there are any.
    """
    said, wanted = plain.split(), significant(plain)
    size = min(max(len(said) + 4, 8), max(len(page.listed), 1))
    starts = np.arange(0, max(len(page.listed) - size + 1, 1), max(1, min(8, len(said) // 2)))
    at: list[int] = []
    if wanted:
        at = [k for k, w in enumerate(page.listed) if w in wanted]
        if len({page.listed[k] for k in at}) < 2:
            return 0.0
        lo, hi = np.searchsorted(at, starts), np.searchsorted(at, starts + size)
        starts, lo, hi = (x[hi - lo >= 2] for x in (starts, lo, hi))
    if not len(starts):
        return 0.0
    own = np.bincount(_kinds(plain), minlength=64)
    ends = np.minimum(starts + size, len(page.listed))
    held = page.sums[ends] - page.sums[starts]
    held[:, _BLANK] += np.maximum(ends - starts - 1, 0)
    bound = 2.0 * np.minimum(held, own).sum(axis=1) / np.maximum(held.sum(axis=1) + len(plain), 1)
    best = 0.0
    for k in np.argsort(-bound, kind="stable").tolist():
        if bound[k] <= best or bound[k] < least:
            break
        if wanted and len({page.listed[at[j]] for j in range(lo[k], hi[k])}) < 2:
            continue
        best = max(best, SequenceMatcher(None, plain, " ".join(page.listed[starts[k] : ends[k]])).ratio())
    return best


def evidence(claim: str, plain: str, page: Page, least: float = 0.0) -> Evidence:
    """What ``page`` says about a claim (``plain`` in the form of pages); windows below ``least`` need not be scored exactly."""
    if not plain or not page.plain:
        return Evidence("empty", False, 0.0)
    if plain in page.plain:
        return Evidence("exact", True, 1.0)
    words = content(plain)
    if words:
        hit = [w for w in words if page.has(w)]
        n, part = len(hit), len(hit) / len(words)
        hard = hard_anchors(claim)
        there = sum(a in page.plain for a in hard)
        if hard:
            matched = (there / len(hard) >= 0.67 and n >= 2 and part >= 0.25) or (there >= 2 and part >= 0.2)
        else:
            matched = (n >= 4 and part >= 0.55) or (n >= 3 and len(words) <= 8 and part >= 0.38 and any(len(w) >= 12 for w in hit))
        if matched:
            # as the share is kept: four places
            return Evidence("words", True, round(part, 4), n, round(there / len(hard), 4) if hard else None)
    if len(plain.split()) < 4:
        return Evidence("short", False, 0.0)
    wanted = significant(plain)
    if wanted and len(wanted & page.words) / len(wanted) < GATE:
        return Evidence("overlap", False, round(len(wanted & page.words) / len(wanted), 4))
    score = best_window(plain, page, least)
    return Evidence("window", score >= MATCH, round(score, 4))


def surely_missing(claim: str, plain: str, page: Page, found: Evidence) -> bool:
    """Whether a claim that has no match is surely not on a page: none of its quotations or none of its hard anchors is there, or none of its words."""
    if not plain or not page.plain:
        return False
    quotes = [q for q in map(match_text, re.findall(r"[\"„“']([^\"„“']{6,})[\"„“']", claim)) if q]
    if quotes and not any(q in page.plain for q in quotes):
        return True
    hard = hard_anchors(claim)
    if hard and not any(a in page.plain for a in hard):
        return True
    words = content(plain)
    return not (found.method == "window" and found.score >= 0.12) and len(words) >= 5 and not any(page.has(w) for w in words)


def _cited_evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for claim, plain, text in zip(batch["claim"], batch["plain"], batch["text"], strict=True):
            page = Page(text or "")
            e = evidence(claim or "", plain, page)
            rows.append((e.method, e.matched, e.score, e.near, not e.matched and surely_missing(claim or "", plain, page, e)))
        out = pd.DataFrame(rows, columns=["method", "matched", "score", "near", "missing"])
        yield pd.concat([batch[["doc", "id"]].reset_index(drop=True), out], axis=1)


def _strong_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        held: dict[str, Page] = {}
        keep = []
        for claim, plain, text in zip(batch["claim"], batch["plain"], batch["text"], strict=True):
            if text not in held:
                held = {} if len(held) > 256 else held
                held[text] = Page(text)
            e = evidence(claim or "", plain, held[text], STRONG)
            keep.append((e.method, e.score) if e.strong else None)
        some = [k for k, e in enumerate(keep) if e]
        out = batch.iloc[some][["doc", "id", "page"]].reset_index(drop=True)
        # typed, as a batch may have none
        out["method"], out["score"] = pd.Series([keep[k][0] for k in some], dtype="object"), pd.Series([keep[k][1] for k in some], dtype="float64")
        yield out


def _heads(plain: Column) -> Column:
    """First four letters of the words that have as many, each once."""
    return F.array_distinct(F.transform(F.filter(F.split(plain, " "), lambda w: F.length(w) >= 4), lambda w: F.substring(w, 1, 4)))


def candidate_pages(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, id, page): the pages that can hold strong evidence for a claim; claims have doc, id, claim and plain, pages doc, page and text.

    Each rule needs so many of a claim's words that a page without any of the rarest others cannot fulfil it: of n words of which t
    have to be there, the n - t + 1 that fewest pages of the document have. Words are compared by their first four letters,
    as similar words share more. Claims without such words can be anywhere in their document.
    """
    stop = [w for w in sorted(STOP) if len(w) >= 4]
    words = F.array_distinct(F.filter(F.split("plain", " "), lambda w: (F.length(w) >= 4) & ~w.isin(stop)))
    hard = F.size(F.filter(F.array(*(F.regexp_extract(F.coalesce("claim", F.lit("")), p, 0) for p in ANCHORS)), lambda x: x != "")) > 0
    said = claims.select("doc", "id", "plain", hard.alias("hard"), words.alias("words"), F.split("plain", " ").alias("all"))
    # sets of words by rule, and how many of each have to be there: as it stands, by words, by windows
    inner = F.array_distinct(F.filter(F.slice("all", 2, F.greatest(F.size("all") - 2, F.lit(0))), lambda w: F.length(w) >= 4))
    long_ = F.filter("words", lambda w: F.length(w) >= 5)
    need = lambda part, few: F.greatest(F.lit(few), F.ceil(F.size(part[0]) * part[1]).cast("int"))
    rules = F.array(
        F.struct(F.lit(0).alias("rule"), inner.alias("of"), F.size(inner).alias("need")),
        F.struct(F.lit(1).alias("rule"), long_.alias("of"), F.when(F.col("hard"), need((long_, F.lit(0.2)), 2)).otherwise(need((long_, F.lit(0.68)), 3)).alias("need")),
        F.struct(F.lit(2).alias("rule"), F.col("words").alias("of"), need(("words", F.lit(GATE)), 2).alias("need")),
    )
    asked = said.select("doc", "id", F.explode(rules).alias("r")).select("doc", "id", "r.rule", "r.need", F.size("r.of").alias("n"), F.explode("r.of").alias("word"))
    asked = asked.withColumn("head", F.substring("word", 1, 4))
    index = pages.select("doc", "page", F.explode(_heads(F.col("text"))).alias("head"))
    common = index.groupBy("doc", "head").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("doc", "id", "rule").orderBy("df", "word"))
    # words that no page has come first and meet nothing
    probes = asked.join(common, ["doc", "head"], "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("rank", rank)
    probes = probes.where((F.col("rank") <= F.col("n") - F.col("need") + 1) & (F.col("df") > 0)).select("doc", "id", "head").distinct()
    met = probes.join(index, ["doc", "head"]).select("doc", "id", "page")
    # as it stands without an inner word, or by windows without a word that counts
    bare = said.where((F.size(inner) == 0) | (F.size("words") == 0)).where("plain <> ''").select("doc", "id")
    return met.union(bare.join(pages.select("doc", "page"), "doc").select("doc", "id", "page")).distinct()


def standing(claims: DataFrame, pages: DataFrame, doc: str, claim_id: str, page_no: str, claim: str, page: str) -> DataFrame:
    """(doc, claim_id, page_no) for pages of a claim's document in which it stands as it is.

    A claim's first and last word may be parts of words, so a page has to have its inner words; claims meet pages by the longest of these, which few
    pages share. Claims of one or two words are looked for on all pages of their document. Null and empty claims stand nowhere.
    """
    said = claims.where(F.length(claim) > 0).select(doc, claim_id, claim, F.split(claim, r"\s+").alias("_all"))
    said = said.withColumn("_inner", F.filter(F.slice("_all", 2, F.greatest(F.size("_all") - 2, F.lit(0))), lambda w: w != ""))
    longest = F.array_max(F.transform("_inner", lambda w: F.named_struct(F.lit("n"), F.length(w), F.lit("w"), w)))["w"]
    probes = said.where(F.size("_inner") > 0).select(doc, claim_id, longest.alias("_word"))
    index = pages.select(doc, page_no, F.explode(F.array_distinct(F.split(page, r"\s+"))).alias("_word"))
    met = index.join(probes, [doc, "_word"]).select(doc, claim_id, page_no)
    bare = said.where(F.size("_inner") == 0).select(doc, claim_id).join(pages.select(doc, page_no), doc)
    pairs = met.unionByName(bare.select(doc, claim_id, page_no))
    return pairs.join(said.select(doc, claim_id, claim), [doc, claim_id]).join(pages.select(doc, page_no, page), [doc, page_no]).where(F.contains(F.col(page), F.col(claim))).select(doc, claim_id, page_no)


def shared_words(claims: DataFrame, pages: DataFrame, doc: str, claim_id: str, page_no: str, claim: str, page: str, least: float = GATE) -> DataFrame:
    """(doc, claim_id, page_no, share): pages that have ``least`` of a claim's distinct words, and what part of them.

    Of n words of which t have to be there a page has one of the n - t + 1 rarest; only these join, and the words of both are then compared.
    With ``least`` 0 every claim meets every page of its document, and only words are sent, once for each claim and page (by document, as one task would scan a small file).
    """
    words = lambda c: F.array_distinct(F.split(normal(F.col(c)), " "))
    said, held = claims.select(doc, claim_id, words(claim).alias("_said")), pages.select(doc, page_no, words(page).alias("_held"))
    share = F.size(F.array_intersect("_said", "_held")) / F.size("_said")
    if least <= 0:
        return held.join(said.hint("merge"), doc).select(doc, claim_id, page_no, share.alias("share"))
    index = held.select(doc, page_no, F.explode("_held").alias("_word"))
    common = index.groupBy(doc, "_word").agg(F.count(F.lit(1)).alias("_df"))
    need = F.ceil(F.size("_said") * F.lit(least) - 1e-9)
    asked = said.select(doc, claim_id, (F.size("_said") - F.greatest(need, F.lit(1)) + 1).alias("_first"), F.explode("_said").alias("_word")).join(common, [doc, "_word"], "left")
    rank = F.row_number().over(Window.partitionBy(doc, claim_id).orderBy(F.coalesce("_df", F.lit(0)), "_word"))
    probes = asked.withColumn("_k", rank).where((F.col("_k") <= F.col("_first")) & F.col("_df").isNotNull()).select(doc, claim_id, "_word")
    pairs = probes.join(index, [doc, "_word"]).select(doc, claim_id, page_no).distinct()
    both = pairs.join(said, [doc, claim_id]).join(held, [doc, page_no])
    return both.select(doc, claim_id, page_no, share.alias("share")).where(F.col("share") >= least)


def _with_texts(met: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (doc, id, page, ...) with the texts of their pages: over several tasks a core, the pairs of a page side by side."""
    return spread(met, "doc", "page").join(spread(held, "doc", "page").hint("merge"), ["doc", "page"])


def _resembling(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: dict[str, Page] = {}
            scores = []
            for plain, text in zip(batch["plain"], batch["text"], strict=True):
                if text not in held:
                    held = {} if len(held) > 256 else held
                    held[text] = Page(text)
                page, wanted = held[text], significant(plain)
                close = not wanted or len(wanted & page.words) >= GATE * len(wanted)
                scores.append(1.0 if plain in text else best_window(plain, page, least) if close else 0.0)
            yield batch[["doc", "id", "page"]].assign(score=scores).loc[lambda x: x["score"] >= least]

    return run


def resembling(claims: DataFrame, pages: DataFrame, doc: str, claim_id: str, page_no: str, claim: str, page: str, least: float = MATCH) -> DataFrame:
    """(doc, claim_id, page_no, score): pages of a claim's document with a window of words that resembles it by ``least`` at least."""
    own = claims.select(F.col(doc).alias("doc"), F.col(claim_id).alias("id"), F.col(claim).alias("claim"), match_form(F.coalesce(F.col(claim), F.lit(""))).alias("plain")).where("plain <> ''")
    held = pages.select(F.col(doc).alias("doc"), F.col(page_no).alias("page"), match_form(F.coalesce(F.col(page), F.lit(""))).alias("text")).where("text <> ''")
    own, held = cut(own), cut(held)
    met = candidate_pages(own, held).join(own, ["doc", "id"]).select("doc", "id", "page", "plain")
    pairs = _with_texts(met, held).select("doc", "id", "page", "plain", "text")
    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("doc", "id", "page")) + ", score double"
    return pairs.mapInPandas(_resembling(least), schema).select(F.col("doc").alias(doc), F.col("id").alias(claim_id), F.col("page").alias(page_no), "score")


def _first_strong(claim: str, plain: str, held: dict[int, Page], cited: set) -> tuple[int, str, float] | None:
    """(page, method, score) of the first page, in order, that is not cited and bears a claim out strongly."""
    words, wanted, short = content(plain), significant(plain), len(plain.split()) < 4
    least = max(2, ceil(len(words) * 0.2)) if hard_anchors(claim) else max(3, ceil(len(words) * 0.68))
    for number, page in held.items():
        if number in cited:
            continue
        if plain not in page.plain:
            # neither enough words that could be there nor windows worth a look
            there = sum(w in page.words or (len(w) >= 7 and w[:5] in page.heads) for w in words)
            if there < least and (short or (wanted and len(wanted & page.words) / len(wanted) < GATE)):
                continue
        e = evidence(claim, plain, page, STRONG)
        if e.strong:
            return number, e.method, e.score
    return None


def _checked_rows(claims: list[tuple], pages: list[tuple]) -> Iterator[tuple]:
    """(id, method, matched, score, near, missing, other page, method, score) for each (id, claim, cited) of a document, from its (page, text)."""
    raw: dict[int, str] = {}
    for number, text in pages:
        if text is not None and (number not in raw or text < raw[number]):
            raw[number] = text
    held = {n: Page(plain) for n in sorted(raw) if (plain := match_text(raw[n]))}
    together: dict[tuple, Page] = {(n,): page for n, page in held.items()}
    for key, claim, cited in claims:
        claim, own = claim or "", tuple(n for n in cited or () if n in held)
        if not own:
            yield (key, *[None] * 8)
            continue
        if own not in together:
            together[own] = Page(" ".join(held[n].plain for n in own))
        plain = match_text(claim)
        e = evidence(claim, plain, together[own])
        other = None if e.matched or not plain else _first_strong(claim, plain, held, set(cited))
        yield key, e.method, e.matched, e.score, e.near, not e.matched and surely_missing(claim, plain, together[own], e), *(other or [None] * 3)


def check_claims(claims: DataFrame, pages: DataFrame, doc: str, claim_id: str, page_no: str, claim: str = "claim", cited: str = "cited", page: str = "page_text", wide: int = WIDE) -> DataFrame:
    """A row for each claim: document, id, status, page, method and score of the evidence that decides.

    ``claims`` cites pages by an array of numbers, ``pages`` has one row for each. Statuses: ``no_text`` if none of the cited pages has text,
    ``verified`` if they bear the claim out, together; else ``other_page`` if another page of the document does strongly (the first one) and the cited ones hold no
    near evidence, ``not_found`` if the claim is surely missing from the cited pages, and ``ambiguous`` in all other cases. Claims that are null or
    empty are ambiguous where there is text; repeated pages count once, the first in order of text. Ids of claims are unique within a document.

    Claims and pages meet by document in one task. Those of documents with more than ``wide`` of either meet by words: see :func:`candidate_pages`.
    """
    own = claims.select(F.col(doc).alias("doc"), F.col(claim_id).alias("id"), F.col(claim).alias("claim"), F.col(cited).cast("array<bigint>").alias("cited"))
    held = pages.select(F.col(doc).alias("doc"), F.col(page_no).cast("long").alias("page"), F.col(page).alias("raw"))
    near, far = parted(own, held, "doc", wide)
    fields = T.StructType.fromDDL("method string, matched boolean, score double, near boolean, missing boolean, page long, other_method string, other_score double").fields
    out = by_document(near[0], near[1].where("page is not null"), _checked_rows, [own.schema["id"], *fields])
    other = F.when(F.col("page").isNotNull(), F.struct("page", F.col("other_method").alias("method"), F.col("other_score").alias("score"))).alias("other")
    out = out.select("doc", "id", "method", "matched", "score", "near", "missing", other)
    if far is not None:
        out = out.unionByName(_checked_by_joins(*far))
    elsewhere = F.col("other").isNotNull()
    status = F.when(F.col("method").isNull(), "no_text").when(F.col("matched"), "verified").when(elsewhere & ~F.col("near"), "other_page").when(elsewhere | F.col("near") | ~F.col("missing"), "ambiguous").otherwise("not_found")
    of = lambda c: F.when(F.col("matched") | ~elsewhere, F.col(c)).otherwise(F.col(f"other.{c}")).alias(c)
    return out.select(F.col("doc").alias(doc), F.col("id").alias(claim_id), status.alias("status"), F.when(elsewhere, F.col("other.page")).alias("page"), of("method"), of("score"))


def _checked_by_joins(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """The evidence of :func:`check_claims` for documents of any width; claims have doc, id, claim and cited, pages doc, page and raw."""
    own = claims.withColumn("plain", match_form(F.coalesce("claim", F.lit(""))))
    held = pages.groupBy("doc", "page").agg(F.min("raw").alias("raw")).select("doc", "page", match_form(F.coalesce("raw", F.lit(""))).alias("text")).where("text <> ''")
    own, held = cut(own), cut(held)
    each = own.select("doc", "id", F.posexplode("cited").alias("at", "page")).withColumn("page", F.col("page").cast("long"))
    together = each.join(held, ["doc", "page"]).groupBy("doc", "id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("t")).select("doc", "id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))
    kinds = {c: own.schema[c].dataType.simpleString() for c in ("doc", "id")}
    key = f"doc {kinds['doc']}, id {kinds['id']}"
    on_cited = spread(own.join(together, ["doc", "id"]).select("doc", "id", "claim", "plain", "text"), "doc", "id")
    on_cited = cut(on_cited.mapInPandas(_cited_evidence, f"{key}, method string, matched boolean, score double, near boolean, missing boolean"))
    # other pages matter only to claims that the cited ones do not bear out
    open_ = own.join(on_cited.where("not matched").select("doc", "id"), ["doc", "id"], "left_semi")
    met = candidate_pages(open_, held).join(each.select("doc", "id", "page"), ["doc", "id", "page"], "left_anti")
    pairs = _with_texts(met.join(own.select("doc", "id", "claim", "plain"), ["doc", "id"]), held).select("doc", "id", "page", "claim", "plain", "text")
    strong = pairs.mapInPandas(_strong_pages, f"{key}, page long, method string, score double").groupBy("doc", "id").agg(F.min(F.struct("page", "method", "score")).alias("other"))
    out = own.select("doc", "id").join(on_cited, ["doc", "id"], "left").join(strong, ["doc", "id"], "left")
    return out.select("doc", "id", "method", "matched", "score", "near", "missing", "other")


def across_documents(checks: DataFrame, keys: list[str], doc: str) -> DataFrame:
    """Of the checks of one claim against several documents, one: what a single document verifies, else what a single one has on another page.

    Several documents that verify a claim, or none of both kinds, leave it ambiguous; ``no_text`` if no document has text for it.
    """
    s = F.col("status")
    n = lambda x: F.count(F.when(s == x, 1))
    one = lambda x: F.min(F.when(s == x, F.struct(F.col(doc), "page")))
    g = checks.groupBy(*keys).agg(n("verified").alias("v"), n("other_page").alias("o"), n("no_text").alias("t"), F.count(F.lit(1)).alias("n"), one("verified").alias("a"), one("other_page").alias("b"))
    status = F.when(F.col("v") == 1, "verified").when(F.col("v") > 1, "ambiguous").when(F.col("o") == 1, "other_page").when(F.col("t") == F.col("n"), "no_text").otherwise("ambiguous")
    chosen = F.when(F.col("v") == 1, F.col("a")).when((F.col("v") == 0) & (F.col("o") == 1), F.col("b"))
    return g.select(*keys, status.alias("status"), chosen[doc].alias(doc), chosen["page"].alias("page"), F.col("n").alias("documents"))


def tallies(checks: DataFrame, *keys: str) -> DataFrame:
    """How many checks have each status, and all of them."""
    return checks.groupBy(*keys).agg(*(F.count(F.when(F.col("status") == x, 1)).alias(x) for x in STATUSES), F.count(F.lit(1)).alias("n"))


def quote_likeness(quote: str, text: str, least: float) -> bool:
    """Whether a quotation of 25 characters or more stands in a text, or a window of its length that begins at every quarter of it is alike by ``least``."""
    quote, text = (" ".join((x or "").lower().split()) for x in (quote, text))
    if len(quote) < 25:
        return False
    if quote in text:
        return True
    size = len(quote)
    starts = np.arange(0, max(1, len(text) - size + 1), max(1, size // 4))
    kinds = _kinds(text)
    own = np.bincount(_kinds(quote), minlength=64)
    # characters of each kind before each window, a slice of the text at a time
    for lo in range(0, len(starts), 512):
        some = starts[lo : lo + 512]
        base, end = int(some[0]), min(len(text), int(some[-1]) + size)
        counts = np.zeros((end - base + 1, 64), np.int32)
        counts[np.arange(1, end - base + 1), kinds[base:end]] = 1
        counts = counts.cumsum(axis=0)
        held = counts[np.minimum(some + size, end) - base] - counts[some - base]
        bound = 2.0 * np.minimum(held, own).sum(axis=1) / (held.sum(axis=1) + size)
        for k in np.flatnonzero(bound >= least).tolist():
            if SequenceMatcher(None, quote, text[some[k] : some[k] + size]).ratio() >= least:
                return True
    return False


def quoted(quote: Column, text: Column, scanned: Column, least: float = 0.9, least_scanned: float = 0.8) -> Column:
    """Whether a quotation stands in a text, nearly; scanned texts are held to less. Null and short quotations prove nothing."""

    @F.pandas_udf("boolean")
    def run(quotes: pd.Series, texts: pd.Series, scans: pd.Series) -> pd.Series:
        return pd.Series([quote_likeness(q, t, least_scanned if s else least) for q, t, s in zip(quotes, texts, scans, strict=True)])

    return run(quote, text, scanned)


# Months of dates in prose.
MONTHS = (
    ("january", 1), ("february", 2), ("march", 3), ("april", 4), ("may", 5), ("june", 6), ("july", 7), ("august", 8), ("september", 9), ("october", 10), ("november", 11), ("december", 12),
    ("januar", 1), ("februar", 2), ("märz", 3), ("mai", 5), ("juni", 6), ("juli", 7), ("oktober", 10), ("dezember", 12),
)
# How facts of drafts are written.
DATE = r"\b\d{2}\.\d{2}\.\d{4}\b"
FILE = r"\b\d{1,3}\s[A-Z]{1,3}\s\d{1,5}/\d{2}(?:\.[A-Z])?\b"
AMOUNT = r"\b\d{1,3}(?:\.\d{3})*(?:,\d{2})?\s?(?:EUR\b|€)"


def _month_number(word: Column) -> Column:
    return F.element_at(F.create_map(*(x for n, k in MONTHS for x in (F.lit(n), F.lit(k)))), F.lower(word))


def known_dates(text: Column) -> Column:
    """The dates of a source as dd.mm.yyyy: written so, in prose, by ISO, and those in prose without a year for every year 20.. it names."""
    t = F.coalesce(text, F.lit(""))
    names = "|".join(n for n, _ in sorted(MONTHS, key=lambda m: -len(m[0])))
    listed = lambda p, g=0: F.regexp_extract_all(t, F.lit(p), F.lit(g))

    def dated(day: Column, month: Column, year: Column) -> Column:
        ok = day.cast("int").between(1, 31) & month.between(1, 12)
        return F.when(ok, F.concat(F.lpad(day.cast("int").cast("string"), 2, "0"), F.lit("."), F.lpad(month.cast("string"), 2, "0"), F.lit("."), year))

    prose = rf"(?iu)\b(\d{{1,2}})\.?\s+({names})\s+(\d{{4}})\b"
    bare = rf"(?iu)\b(\d{{1,2}})\.?\s+({names})\b(?!\s+\d{{4}})"
    iso = r"\b(\d{4})-(\d{2})-(\d{2})\b"
    # a text is searched once for each pattern, and what it finds taken apart
    of = lambda x, p, g: F.regexp_extract(x, p, g)
    written = F.transform(listed(prose), lambda x: dated(of(x, prose, 1), _month_number(of(x, prose, 2)), of(x, prose, 3)))
    by_iso = F.transform(listed(iso), lambda x: dated(of(x, iso, 3), of(x, iso, 2).cast("int"), of(x, iso, 1)))
    years = F.array_distinct(listed(r"\b(20\d{2})\b", 1))
    days = F.transform(listed(bare), lambda x: F.struct(of(x, bare, 1).alias("d"), _month_number(of(x, bare, 2)).alias("m")))
    any_year = F.flatten(F.transform(days, lambda x: F.transform(years, lambda y: dated(x["d"], x["m"], y))))
    return F.array_distinct(F.filter(F.concat(listed(DATE), written, by_iso, any_year), lambda x: x.isNotNull()))


def facts_of(text: Column) -> Column:
    """The facts of a draft (array of type, value, key): dates, file numbers and amounts, each key once."""
    t = F.coalesce(text, F.lit(""))

    def each(kind: str, pattern: str, key) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        keys = F.transform(found, key)
        one = F.transform(found, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), key(v).alias("key")))
        return F.filter(one, lambda x, i: F.array_position(keys, x["key"]) == i + 1)

    return F.concat(each("date", DATE, lambda v: v), each("file_number", FILE, _file_key), each("amount", AMOUNT, lambda v: F.replace(v, F.lit(" "), F.lit(""))))


def _file_key(v: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(v, r"\s+", " ")))


def source_facts(text: Column) -> Column:
    """The keys (array of type, key) of the facts that a source has."""
    t = F.coalesce(text, F.lit(""))
    typed = lambda kind, a: F.transform(a, lambda k: F.struct(F.lit(kind).alias("type"), k.alias("key")))
    files = F.transform(F.regexp_extract_all(t, F.lit(FILE), F.lit(0)), _file_key)
    amounts = F.transform(F.regexp_extract_all(t, F.lit(AMOUNT), F.lit(0)), lambda v: F.replace(v, F.lit(" "), F.lit("")))
    return F.array_distinct(F.concat(typed("date", known_dates(text)), typed("file_number", files), typed("amount", amounts)))


def unsupported(drafts: DataFrame, sources: DataFrame, draft_id: str, draft: str, within: str, source: str) -> DataFrame:
    """(draft_id, type, value, severity, status): facts of drafts that no source of the same ``within`` has.

    Dates and file numbers are of high severity (``not_in_sources``); amounts may be computed and are of low (``unverified``). Facts of sources are
    counted once for each ``within``; drafts without any source there are not checked. A date without its year counts for the years that its own source names.
    """
    drafts, sources = spread(drafts.select(*dict.fromkeys((draft_id, within)), draft), within), spread(sources.select(within, source), within)
    said = drafts.select(*dict.fromkeys((draft_id, within)), F.explode(facts_of(F.col(draft))).alias("f")).select(*dict.fromkeys((draft_id, within)), "f.*")
    checked = sources.where(F.trim(F.coalesce(F.col(source), F.lit(""))) != "").select(within).distinct()
    known = sources.select(within, F.explode(source_facts(F.col(source))).alias("f")).select(within, "f.*").distinct()
    open_ = said.join(checked, within, "left_semi").join(known, [within, "type", "key"], "left_anti")
    low = F.col("type") == "amount"
    return open_.select(draft_id, "type", "value", F.when(low, "low").otherwise("high").alias("severity"), F.when(low, "unverified").otherwise("not_in_sources").alias("status"))
