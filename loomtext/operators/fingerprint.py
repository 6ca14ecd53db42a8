"""What a case is about, read from its prose and its facets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import fold

URGENCY = ("evergreen", "normal", "urgent")
SECTION = r"(?i)§\s?\d+[a-z]?(?:\s?abs\.?\s?\d+)?"


def _rank(urgency: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, URGENCY)), urgency), F.lit(2)).cast("int")


def prose_fingerprint(text: Column, countries: Sequence[str], signals: Sequence[tuple[str, str, str]]) -> Column:
    """A struct of countries, legal_area, urgency and issue_tags from a text.

    ``signals`` are (needle, area, urgency) in order: the first whose needle occurs names the area; all that occur are tags, beside the
    sections cited. Needles are compared folded. Without a signal there is no area and the urgency is normal.
    """
    hay = fold(F.coalesce(text, F.lit("")))
    has = lambda needle: hay.contains(fold(F.lit(needle)))
    area, urgency = F.lit(None).cast("string"), F.lit("normal")
    for needle, name, how in reversed(signals):
        area, urgency = F.when(has(needle), F.lit(name)).otherwise(area), F.when(has(needle), F.lit(how)).otherwise(urgency)
    found = lambda names: F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(has(n), F.lit(n)) for n in names)))))
    sections = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SECTION), F.lit(0)), lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))))
    tags = F.array_sort(F.array_distinct(F.concat(sections, found([s[0] for s in signals]))))
    return F.struct(found(countries).alias("countries"), area.alias("legal_area"), urgency.alias("urgency"), tags.alias("issue_tags"))


def matchable(country: Column, norms: Column, themes: Column) -> Column:
    """Whether facets can be matched at all: a country, a norm or a theme is there."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return F.coalesce(F.trim(country) != "", F.lit(False)) | some(norms) | some(themes)


def fingerprint(prose: Column, country: Column, norms: Column, themes: Column, area: Column, urgency: Column) -> Column:
    """The fingerprint of a case: from its facets where these can be matched, else from its prose.

    ``area`` and ``urgency`` follow from the kind of proceedings; prose can raise the urgency, gives the area where none follows, and
    its tags stay beside as ``prose_tags``.
    """
    facets = matchable(country, norms, themes)
    none = F.array().cast("array<string>")
    tags = F.array_sort(F.array_distinct(F.concat(F.coalesce(norms, none), F.coalesce(themes, none))))
    higher = F.when(_rank(prose["urgency"]) > _rank(urgency), prose["urgency"]).otherwise(F.coalesce(urgency, F.lit("normal")))
    return F.struct(
        F.when(facets, F.when(F.trim(country) != "", F.array(country)).otherwise(none)).otherwise(prose["countries"]).alias("countries"),
        F.when(facets, F.coalesce(area, prose["legal_area"])).otherwise(prose["legal_area"]).alias("legal_area"),
        F.when(facets, higher).otherwise(prose["urgency"]).alias("urgency"),
        F.when(facets, tags).otherwise(prose["issue_tags"]).alias("issue_tags"),
        F.when(facets, prose["issue_tags"]).otherwise(none).alias("prose_tags"),
    )


def fingerprint_key(fp: Column) -> Column:
    """Countries, area and tags of a fingerprint as one key of 255 characters at most."""
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return F.substring(F.concat_ws("|", join(fp["countries"]), F.lower(F.trim(F.coalesce(fp["legal_area"], F.lit("")))), join(fp["issue_tags"])), 1, 255)
