"""Sectioned blocks of text under one budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.jobs import folded

# Headings of the sections of scored decisions, in order.
HEADINGS = ("## STÜTZEND", "## STÜTZEND MIT VORSICHT (Distinguish-Risiko)", "## GEGEN UNS")
# Names of the axes on which a decision can differ.
AXES = {"alter": "Alter", "geschlecht": "Geschlecht", "gesundheit": "Gesundheit", "familienstand": "Familienstand", "netzwerk_im_herkunftsland": "Netzwerk im Herkunftsland"}


def decision_section(camp: Column, risk: Column, stale: Column) -> Column:
    """Number of a decision's section: 0 supports without a risk of being told apart, 2 is against, 1 is all else; what is out of date never leads."""
    safe = (camp == "pro") & risk.isin("niedrig", "ungeprueft") & ~F.coalesce(stale, F.lit(False))
    return F.when(F.coalesce(camp == "gegen", F.lit(False)), 2).when(F.coalesce(safe, F.lit(False)), 0).otherwise(1)


def risk_note(camp: Column, risk: Column, bearing: Column, differing: Column) -> Column:
    """What is said about how a decision can be told apart: a chance if it is against, a risk if it rests on an axis that differs; may be empty."""
    names = lambda axes: F.array_join(F.transform(axes, lambda a: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in AXES.items() for x in kv)), a), a)), ", ")
    bearing, differing = (F.coalesce(c, F.array().cast("array<string>")) for c in (bearing, differing))
    labels = names(F.when(F.size(bearing) > 0, bearing).otherwise(differing))
    against, high, neutral = (F.coalesce(x, F.lit(False)) for x in (camp == "gegen", risk == "hoch", camp == "neutral"))
    return (
        F.when(against & (labels != ""), F.concat(F.lit("- Unterscheidbar: dort abweichend — "), labels))
        .when(against, "")
        .when(high, F.concat(F.lit("- RISIKO: leicht zu unterscheiden — Entscheidung trägt auf: "), labels))
        .when(neutral, "- Hinweis: Ergebnis unklar/ungeprüft — nicht ungeprüft zitieren")
        .when(labels != "", F.concat(F.lit("- Hinweis: Profil weicht ab ("), labels, F.lit(")")))
        .otherwise("")
    )


def sectioned(entries: DataFrame, key: str, section: str, order: list[Column], text: str, headings: tuple[str, ...] = HEADINGS, budget: int = 3500) -> DataFrame:
    """(key, block, entries): for each key its texts by section, in ``order``, as far as they fit a budget that all sections share.

    A text that does not fit what is left, with its section's heading, is skipped, and shorter ones after it may still be taken; a section's heading counts
    when it is done, and one without texts is left out. Texts are parted by empty lines. Keys whose texts all are too long have an empty
    block; null texts and sections are left out. Texts of a key are streamed in order: a task holds one block.
    """

    def begin() -> dict:
        return {"left": budget, "section": None, "parts": [], "here": [], "n": 0, "key": None}

    def close(state: dict) -> None:
        if state["here"]:
            title = headings[state["section"]]
            state["parts"].append("\n\n".join([title, *state["here"]]))
            state["left"] -= len(title)
        state["here"] = []

    def step(state: dict, row) -> list[tuple]:
        state["key"] = getattr(row, key)
        if row.section_ != state["section"]:
            close(state)
            state["section"] = row.section_
        if len(row.text_) + len(headings[row.section_]) <= state["left"]:
            state["here"].append(row.text_)
            state["left"] -= len(row.text_)
            state["n"] += 1
        return []

    def end(state: dict) -> list[tuple]:
        close(state)
        return [(state["key"], "\n\n".join(state["parts"]), state["n"])]

    given = entries.select(key, F.col(section).cast("int").alias("section_"), *(c.alias(f"order{n}_") for n, c in enumerate(order)), F.col(text).alias("text_"))
    given = given.where(F.col("section_").between(0, len(headings) - 1) & F.col("text_").isNotNull())
    kind = entries.schema[key].dataType.simpleString()
    return folded(given, key, ["section_", *(f"order{n}_" for n in range(len(order)))], begin, step, end, f"{key} {kind}, block string, entries long")
