"""File numbers, courts, statute references and the identities made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"([0-9]{1,3} [A-Z]{1,3} [0-9]{1,5}/[0-9]{2})"
# Courts that stand before a file number.
COURTS = "VG|OVG|VGH|BayVGH|BVerwG|BVerfG|BSG|LSG|SG|BGH|OLG|LG|AG|BFH|FG|EuGH|EGMR"
PARAGRAPH = r"(§ ?[0-9]+[a-z]?(?: Abs\. ?[0-9]+)?(?: [A-Z][A-Za-z]*G)?)"


def number_key(c: Column) -> Column:
    """Lower case without blanks and points."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s.]+", "")


def number_core(c: Column) -> Column:
    """Without the leading words that hold no digit (court names)."""
    words = F.split(F.trim(c), r"\s+")
    first = F.array_position(F.transform(words, lambda w: w.rlike("[0-9]")), True)
    return F.when(first > 0, F.array_join(F.slice(words, first.cast("int"), F.size(words)), " ")).otherwise(F.lit(""))


def number_spaced(c: Column) -> Column:
    """Lower case with single blanks."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def number_compared(c: Column) -> Column:
    """As two spellings of one file number are compared: without court, nickname, journal, parties behind a dash, and blanks."""
    c = F.translate(F.coalesce(c, F.lit("")), "\u2011\u2013\u2014", "---")
    for pattern in (r"(?s)\s+-\s+.*$", r"\s*\[[^\]]*\]", r"\s*\([^)]*\)"):
        c = F.regexp_replace(c, pattern, "")
    c = F.trim(F.regexp_replace(F.trim(c), rf"(?i)^(?:{COURTS})\b[.\s]*", ""))
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[\s.]*\b(?:OVG|VGH|VG)$", ""), r"\s+", ""))


def number_tight(c: Column) -> Column:
    """Lower case without blanks."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")


def decision_sha(court: Column, day: Column, number: Column) -> Column:
    """Identity of a decision: canonical court, ISO date and number key."""
    name = F.trim(F.regexp_replace(F.regexp_replace(F.lower(court), "verwaltungsgericht", "vg"), r"\s+", " "))
    return F.sha2(F.concat_ws("|", name, F.coalesce(day.cast("string"), F.lit("")), number_key(number)), 256)


def case_hash(path: Column) -> Column:
    """Twelve digits of the hash of the first NNN/YY in a path; null without one."""
    ref = F.regexp_extract(path, "([0-9]{1,4}/[0-9]{2})", 1)
    return F.when(ref != "", F.substring(F.sha2(ref, 256), 1, 12))


def provisions(c: Column) -> Column:
    """Statute references in order of appearance, each once, blanks after the sign dropped."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PARAGRAPH), F.lit(1)), lambda x: F.regexp_replace(x, "§ ", "§")))


def plain_text(markdown: Column) -> Column:
    """Markdown without its marks."""
    for pattern, to in ((r"(?m)^#{1,6} *", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"`([^`]*)`", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^[-*] +", "• ")):
        markdown = F.regexp_replace(markdown, pattern, to)
    return markdown
