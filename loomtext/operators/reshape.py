"""Answers of models as flat JSON, put into nested fields with checked values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The profile's axes, further keys of a profile, and the roles an axis can play in a decision.
AXES = ("alter", "geschlecht", "gesundheit", "familienstand", "netzwerk_im_herkunftsland")
PROFILE = (*AXES, "besonderheiten")
ROLES = ("traegt", "erwaehnt", "irrelevant")


def _fields(answer: Column) -> Column:
    """The fields of a JSON object as variants; none for anything else."""
    whole = F.try_parse_json(F.coalesce(answer, F.lit("")))
    there = F.schema_of_variant(whole).startswith("OBJECT")
    return F.when(F.coalesce(there, F.lit(False)), F.from_json(answer, "map<string,variant>"))


def _says(value: Column) -> Column:
    """Whether a value is something: not null, an empty text, list or object."""
    return value.isNotNull() & ~F.coalesce(F.to_json(value), F.lit("null")).isin("null", '""', "[]", "{}")


def nested(answer: Column, group: str = "profil", keys: Sequence[str] = PROFILE) -> Column:
    """A flat JSON object with the fields in ``keys`` moved into ``group``, as JSON; fields that say nothing go. Null and other JSON give an empty object.

    Fields keep their order, numbers and lists their types.
    """
    said = F.map_filter(F.coalesce(_fields(answer), F.create_map().cast("map<string,variant>")), lambda k, v: _says(v))
    outer, inner = F.map_filter(said, lambda k, v: ~k.isin(*keys) & (k != group)), F.map_filter(said, lambda k, v: k.isin(*keys))
    return F.when(F.size(inner) == 0, F.to_json(outer)).otherwise(F.to_json(F.map_concat(outer, F.create_map(F.lit(group), F.parse_json(F.to_json(inner))))))


def chosen(answer: Column, key: str, allowed: Sequence[str]) -> Column:
    """The value of a field in lower case if it is one of ``allowed``, else null."""
    said = F.lower(F.trim(F.try_variant_get(F.try_parse_json(F.coalesce(answer, F.lit(""))), f"$.{key}", "string")))
    return F.when(said.isin(*allowed), said)


def roles(answer: Column, axes: Sequence[str] = AXES, prefix: str = "reliance_", allowed: Sequence[str] = ROLES) -> Column:
    """The roles of the axes (map of axis to role) that an answer gives in the closed vocabulary; other values are left out."""
    held = F.create_map(*(x for a in axes for x in (F.lit(a), chosen(answer, prefix + a, allowed))))
    return F.map_filter(held, lambda k, v: v.isNotNull())


def unknown_roles(answer: Column, axes: Sequence[str] = AXES, prefix: str = "reliance_", allowed: Sequence[str] = ROLES) -> Column:
    """Axes whose role is given in other words, in order."""
    variant = F.try_parse_json(F.coalesce(answer, F.lit("")))
    said = lambda a: F.trim(F.coalesce(F.try_variant_get(variant, f"$.{prefix}{a}", "string"), F.lit("")))
    return F.array_compact(F.array(*(F.when((said(a) != "") & ~F.lower(said(a)).isin(*allowed), F.lit(a)) for a in axes)))


def classification(answer: Column, categories: Mapping[str, str]) -> Column:
    """(category, confidence, explanation, error): a model's class by a closed map of its words.

    Confidence is held between 0 and 1, 0 where it is none. An unknown class is an error and not a class, and so is an answer that is no JSON object.
    """
    variant = F.try_parse_json(F.coalesce(answer, F.lit("")))
    get = lambda key, kind: F.try_variant_get(variant, f"$.{key}", kind)
    is_object = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    word = F.lower(F.trim(F.coalesce(get("category", "string"), F.lit(""))))
    category = F.try_element_at(F.create_map(*(F.lit(x) for kv in categories.items() for x in kv)), word)
    number = F.coalesce(get("confidence", "double"), F.lit(0.0))
    confidence = F.when(F.isnan(number), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    error = F.when(~is_object, "no valid JSON").when(category.isNull(), F.concat(F.lit("unknown category: "), F.coalesce(get("category", "string"), F.lit("null"))))
    ok = error.isNull()
    return F.struct(category.alias("category"), F.when(ok, confidence).alias("confidence"), F.when(ok, F.trim(F.coalesce(get("explanation", "string"), F.lit("")))).alias("explanation"), error.alias("error"))
