"""Predicates and gates as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def metadata_filter(equal: dict | None = None, among: dict | None = None, since: dict | None = None, until: dict | None = None, overlap: dict | None = None) -> Column:
    """All given clauses together: equality, membership, date bounds and array overlap by column name. Apply before any top-k."""
    out = F.lit(True)
    for name, value in (equal or {}).items():
        out = out & (F.col(name) == value)
    for name, values in (among or {}).items():
        out = out & F.col(name).isin(*values)
    for name, day in (since or {}).items():
        out = out & (F.col(name) >= F.lit(day).cast("date"))
    for name, day in (until or {}).items():
        out = out & (F.col(name) <= F.lit(day).cast("date"))
    for name, values in (overlap or {}).items():
        out = out & F.arrays_overlap(F.col(name), F.array(*map(F.lit, values)))
    return out


def missing(fields: Sequence[str]) -> Column:
    """Names of the fields that are null or blank."""
    return F.array_compact(F.array(*(F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "", F.lit(f)) for f in fields)))


def changed_output(before: Column, after: Column, entities: Column) -> Column:
    """Whether a redaction did something: not empty, not the input, and some entity."""
    return (F.coalesce(after, F.lit("")) != "") & ~after.eqNullSafe(before) & (F.coalesce(F.size(entities), F.lit(0)) > 0)


def needs_enrichment(material: Column, at: Column, model: Column, label: str) -> Column:
    return material & (at.isNull() | ~model.eqNullSafe(F.lit(label)))


def covers_area(areas: Column, wanted: str) -> Column:
    """Whether any area is the wanted one; null or empty lists are old records and count as yes."""
    return F.coalesce(F.size(areas) == 0, F.lit(True)) | F.exists(F.coalesce(areas, F.array().cast("array<string>")), lambda a: a == wanted)
