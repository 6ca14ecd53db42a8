"""Lines and values that cleaning and redaction leave behind in letters and judgments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import scrub

# Lines of a case's caption, before and after redaction.
CAPTION = (
    r"\s\./\.\s",
    r"(?i)^\s*In (?:dem|der)\b.{0,50}\b(?:Verfahren|Rechtsstreit|Streitsache)\b",
    r"^\s*(?:-\s*)?(?:Kläger(?:s|in)?|Antragsteller(?:s|in)?|Beklagte[rn]?|Antragsgegner(?:in)?)(?:\s+und\s+\w+)?\s*,?\s*(?:-\s*)?$",
    r"^\s*gegen\s*$",
    r"^\s*die Bundesrepublik Deutschland\b",
    r"vertreten durch den (?:Bundesminister|Präsidenten des Bundesamtes)",
    r"Prozessbevollmächtigt",
    r"^\s*(?:des|der|den)\s+\[PERSON\]",
    r"wohnhaft.{0,20}\[ADRESSE\]",
)
MARKERS_ONLY = r"^\s*(?:\[[A-ZÄÖÜ][A-ZÄÖÜ \-]*\]\s*)+[.,;:]?\s*$"
# What is still replaced after redaction, structured blocks first.
RESIDUE: tuple[tuple[str, str], ...] = (
    (r"(?im)^.*Bankverbindung:.*$", "[BANKVERBINDUNG]"),
    (r"(?i)\bIBAN:?\s*[A-Z]{2}\d{2}(?:\s?\d){10,30}\b", "[IBAN]"),
    (r"(?i)\bBIC:?\s*[A-Z0-9]{8,11}\b", "[BIC]"),
    (r"(?i)\bSteuernummer\s+[\d/]+(?:\s+Finanzamt[^\n]*)?", "[STEUERNUMMER]"),
    (r"(?i)\bLG-Fach:?\s*\d+", "[LG-FACH]"),
    (r"\+49[ \t\d]{6,}", "[TEL]"),
    (r"\b\d{3}[a-z]?/\d{2}(?:\s+[A-Z])?\b", "[AKTENZEICHEN]"),
)


def _kept(text: Column, patterns: Sequence[str], line=None) -> Column:
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")

    def stays(x: Column) -> Column:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | x.rlike(p)
        return ~(hit | line(x)) if line else ~hit

    return F.array_join(F.filter(lines, stays), "\n")


def without_letterhead(text: Column, patterns: Sequence[str], anchors: str | None = None, width: int = 70) -> Column:
    """Without the lines that a pattern or the caption matches, and without lines of at most ``width`` characters that name the sender (``anchors``)."""
    named = (lambda x: (F.length(x) <= width) & x.rlike(anchors)) if anchors else None
    return _kept(text, (*patterns, *CAPTION), line=named)


def clean_redacted(text: Column) -> Column:
    """A redacted text without its caption and without lines that hold markers only."""
    return _kept(text, (*CAPTION, MARKERS_ONLY))


def scrub_residue(text: Column) -> Column:
    """A redacted text with what redaction left: bank details, tax and telephone numbers, boxes, file numbers."""
    return scrub(text, RESIDUE)
