"""Which document, file, run, link or title is meant: matches within a case."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unaccent
from ..sources.tables import spread
from .verification import normal

# Words of a citation that point at a category, in the order in which they are tried.
CATEGORY_WORDS: dict[str, tuple[str, ...]] = {
    "bescheid": ("bescheid", "ablehnungsbescheid", "widerspruchsbescheid"),
    "anhoerung": ("anhoerung", "anhörung", "interview"),
    "vorinstanz": ("urteil", "beschluss", "vorinstanz"),
    "rechtsprechung": ("entscheidung", "urteil", "beschluss"),
    "sonstiges": ("schreiben", "nachweis", "unterlage", "attest"),
}
FIRST_EXHIBIT = r"(?i)anlage\s*k\s*2"
SHEET = r"(?i)\bbl\.?\s*\d+"
LINK = r'https?://[^\s<>"{}|\\^`\[\])]+'


def stem(path: Column) -> Column:
    """The last part of a path without its suffix, lower case."""
    return F.lower(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1))


def not_in_case(found: DataFrame, known: DataFrame, case: str, path: str) -> DataFrame:
    """Files whose name the same case does not have yet in any format."""
    have = known.select(case, stem(F.col(path)).alias("_stem")).distinct()
    return found.withColumn("_stem", stem(F.col(path))).join(have, [case, "_stem"], "left_anti").drop("_stem")


def resolve(citations: DataFrame, inventory: DataFrame, case: str, ident: Sequence[str], words: Mapping[str, Sequence[str]] = CATEGORY_WORDS) -> DataFrame:
    """(case, ident, item, rule): the document of the case that each citation means; null if no rule settles on one.

    ``citations`` has source_key, citation, hint and pages (array), ``inventory`` item, source_key, label, category, role, page_start, page_end and
    pages. Rules in order: key; exhibit K 2 is the primary notice; a sheet number is of the one document that covers the page, or
    else of the one file, or of the one that has all these pages; a label in the hint; words of a category; the only document.
    Pairs carry truth values only and are counted before the shuffle.
    """
    said = citations.withColumn("_hint", normal(F.concat_ws(" ", "hint", "citation"))).select(
        case, *ident, F.col("source_key").alias("_key"), "_hint",
        F.col("citation").rlike(FIRST_EXHIBIT).alias("_exhibit"), F.col("citation").rlike(SHEET).alias("_sheet"), F.col("pages").alias("_cited"),
        *(reduce(lambda a, b: a | b, (F.contains(F.col("_hint"), normal(F.lit(w))) for w in ws)).alias(f"_w{i}") for i, ws in enumerate(words.values())),
    )
    # many small tasks: a task sorts and counts its cases in memory
    pair = spread(said, case).join(spread(inventory, case), case, "left")
    some = F.coalesce(F.size("_cited") > 0, F.lit(False))
    rules: list[tuple[str, Column, bool]] = [
        ("key", F.col("_key") == F.col("source_key"), False),
        ("exhibit", F.col("_exhibit") & (F.col("category") == "bescheid") & (F.col("role") == "primary"), False),
        ("sheet", F.col("_sheet") & F.exists("_cited", lambda p: p.between(F.col("page_start"), F.col("page_end"))), True),
        ("file", F.col("_sheet") & (F.col("category") == "akte"), True),
        ("pages", F.col("_sheet") & some & F.forall("_cited", lambda p: F.array_contains("pages", p)), True),
        ("label", (normal(F.col("label")) != "") & F.contains(F.col("_hint"), normal(F.col("label"))), True),
        *(("category", F.col(f"_w{i}") & (F.col("category") == c), True) for i, c in enumerate(words)),
        ("only", F.col("item").isNotNull(), True),
    ]
    counted = pair.groupBy(case, *ident).agg(
        *(F.count(F.when(hit, 1)).alias(f"_n{i}") for i, (_, hit, _) in enumerate(rules)), *(F.min(F.when(hit, F.col("item"))).alias(f"_i{i}") for i, (_, hit, _) in enumerate(rules))
    )
    settled = [F.when(F.col(f"_n{i}") == 1 if alone else F.col(f"_n{i}") > 0, F.struct(F.col(f"_i{i}").alias("item"), F.lit(name).alias("rule"))) for i, (name, _, alone) in enumerate(rules)]
    best = F.coalesce(*settled)
    return counted.select(case, *ident, best["item"].alias("item"), best["rule"].alias("rule"))


def matching_runs(runs: DataFrame, wanted: DataFrame, owner: str, order: Column, text: str, last: int = 40, most: int = 5) -> DataFrame:
    """The newest ``most`` of each owner's ``last`` runs whose text has one of the wanted countries and one of the wanted tags; an empty list asks for nothing."""
    newest = Window.partitionBy(owner).orderBy(order)
    few = runs.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last)
    blob = normal(F.col(text))
    any_of = lambda c: (F.coalesce(F.size(c), F.lit(0)) <= 0) | F.exists(c, lambda t: F.contains(blob, normal(t)))
    hit = few.join(wanted, owner).where(any_of("countries") & any_of("tags"))
    return hit.withColumn("_m", F.row_number().over(Window.partitionBy(owner).orderBy("_n"))).where(F.col("_m") <= most).drop("_n", "_m", "countries", "tags")


def links_with_titles(df: DataFrame, key: str, text: str, before: int = 100) -> DataFrame:
    """(key, n, url, title) for each link of a text, once: the title in brackets before it, else the last phrase before it, else the link.

    Titles are cut inside one expression, so no text is copied for its links.
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def titled(u: Column) -> Column:
        mark = F.instr(t, F.concat(F.lit("]("), u, F.lit(")")))
        bracket = F.when(mark > 1, F.regexp_extract(F.substring(t, F.lit(1), mark - 1), r"\[([^\]]+)$", 1))
        at = F.instr(t, u)
        lead = F.trim(F.substring(t, F.greatest(at - before, F.lit(1)), F.least(at - 1, F.lit(before))))
        phrase = F.trim(F.element_at(F.split(lead, "[.]"), -1))
        return F.struct(u.alias("url"), F.coalesce(F.when(bracket != "", bracket), F.when((at > 1) & (F.length(phrase) > 5), phrase), u).alias("title"))

    each = F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(LINK), F.lit(0))), titled)
    return df.select(key, F.posexplode(each).alias("n", "_link")).select(key, "n", "_link.url", "_link.title")


def title_wanted(title: Column, includes: Sequence[str]) -> Column:
    """Whether an outline title has one of the words, letters without marks; "bescheid" counts only as its last word."""
    plain = lambda c: F.lower(unaccent(c))
    t = plain(F.coalesce(title, F.lit("")))
    hits = [t.rlike(r"\bbescheid$") if w.lower() == "bescheid" else F.contains(t, plain(F.lit(w))) for w in includes if w]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def pick_law(members: Column, abbreviation: Column) -> Column:
    """The first search hit (abbreviation, identifier) that has exactly this abbreviation and an identifier; null rather than a guess."""
    return F.get(F.filter(members, lambda m: (m["abbreviation"] == abbreviation) & (F.coalesce(m["identifier"], F.lit("")) != "")), F.lit(0))


def version_date(identifier: Column) -> Column:
    """The date in an identifier's path, else empty."""
    return F.regexp_extract(F.coalesce(identifier, F.lit("")), r"/(\d{4}-\d{2}-\d{2})/", 1)
