"""Yes-or-no rules on documents, segments, facets, drafts and law texts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories and segment types that the rules know, and the words for internal notes.
OWN_PAPERS = "Mandantenunterlagen"
PRIOR_INSTANCE = "Vorinstanz"
OTHER_SOURCES = "Sonstige gespeicherte Quellen"
CASE_LAW = "rechtsprechung"
PICTURES = ("photo_evidence",)
PERSONAL = ("medical_document", "identity_document", "certificate", "form", "letter", "email_thread")
NOTE = r"(?i)\b(?:Aktennotiz|Kanzleinotiz|Notiz|Gespr[aä]chsnotiz|Besprechungsnotiz|Transkript)\b"
# How a provision's heading begins, and what a law's text must have at least.
HEADING = r"(?m)^#+\s*(?:§|Art\.?)\s*\S+"
LAWS: dict[str, tuple[int, tuple[str, ...]]] = {
    "AsylG": (60, ("§ 3", "§ 30", "§ 77")),
    "AufenthG": (80, ("§ 25", "§ 60", "§ 104")),
    "GG": (100, ("Art 16a",)),
    "AsylbLG": (10, ("§ 2", "§ 4")),
}


def _plain(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def may_segment(n_pages: Column, category: Column) -> Column:
    """Whether a document is split: more than one page, and not case law."""
    return (F.coalesce(n_pages, F.lit(0)) > 1) & ~F.contains(_plain(category), F.lit(CASE_LAW))


def may_read(kind: Column) -> Column:
    """Whether a segment is recognised: all but pictures."""
    return ~_plain(kind).isin(*PICTURES)


def must_anonymise(category: Column, kind: Column) -> Column:
    """Whether a segment is anonymised: all of the client's papers and of the prior instance, of other sources those of a personal kind."""
    c = F.coalesce(category, F.lit(""))
    return c.isin(OWN_PAPERS, PRIOR_INSTANCE) | ((c == OTHER_SOURCES) & _plain(kind).isin(*PERSONAL))


def facets_complete(country: Column, norms: Column, themes: Column, profile: Column) -> Column:
    """Whether nothing is left to extract: a country, norms, themes and a profile (an array of what it holds) are there."""
    some = [F.coalesce(F.size(c) > 0, F.lit(False)) for c in (norms, themes, profile)]
    return F.coalesce(country != "", F.lit(False)) & some[0] & some[1] & some[2]


def names_notes(draft: Column) -> Column:
    """Whether a draft speaks of internal notes."""
    return F.coalesce(draft, F.lit("")).rlike(NOTE)


def named_notes(draft: Column, labels: Column) -> Column:
    """The labels of internal notes that a draft names."""
    plain = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda n: F.trim(n))
    return F.filter(plain, lambda n: (n != "") & F.contains(F.coalesce(draft, F.lit("")), n))


def plausible_law(law: Column, text: Column, laws: Mapping[str, tuple[int, Sequence[str]]] = LAWS, least: int = 10) -> Column:
    """Whether a text can be the whole law: enough headings of provisions, and those of every anchor. Unknown laws have no anchors."""
    n, enough = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(HEADING)), F.lit(least)
    anchored = F.lit(True)
    for name, (headings, anchors) in laws.items():
        there = F.lit(True)
        for a in anchors:
            there = there & F.coalesce(text, F.lit("")).rlike(rf"(?m)^#+\s*{re.escape(a)}(?:\s|$)")
        enough = F.when(law == name, headings).otherwise(enough)
        anchored = F.when(law == name, there).otherwise(anchored)
    return (n >= enough) & anchored
