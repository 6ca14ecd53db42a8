"""Page citations in drafts: where they stand, which pages they name, and the claim they support."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

_PAGE = re.compile(r"\b(?:S\.|Seite|Bl\.|Blatt|p\.)\s*(\d{1,4})(?:\s*[-–]\s*(\d{1,4})|\s*(ff?\.))?", re.IGNORECASE)
_STATUTE = re.compile(r"(?:§|\bArt\.|\bAbs\.|\bNr\.)[^.;]{0,25}$")
_SHORT = ("S.", "Bl.", "p.", "f.", "ff.", "Abs.", "Art.", "Nr.", "vgl.", "Dr.", "z.B.", "d.h.", "u.a.", "bzw.", "Az.")


@dataclass(frozen=True)
class Citation:
    pos: int
    pages: tuple[int, ...]
    open_end: bool
    sentence: str
    claim: str


def _is_end(text: str, k: int) -> bool:
    """Whether the mark at ``k`` ends a sentence: not after an abbreviation or a number, and before a capital or the end."""
    if text[k] in "!?":
        return True
    if text[k] != ".":
        return False
    before = text[: k + 1].rsplit(None, 1)[-1] if text[: k + 1].split() else ""
    after = text[k + 1 :].lstrip()
    before = before.lstrip("([")
    return before not in _SHORT and not re.fullmatch(r"\d+\.", before) and (not after or after[0].isupper() or after[0] in "([\"„")


def sentence_at(text: str, pos: int) -> tuple[int, int]:
    """Bounds of the sentence around a position."""
    lo = pos
    while lo > 0 and not (_is_end(text, lo - 1) or text[lo - 1] == "\n"):
        lo -= 1
    hi = pos
    while hi < len(text) and not (_is_end(text, hi) or text[hi] == "\n"):
        hi += 1
    return lo, min(len(text), hi + 1)


def find(text: str) -> list[Citation]:
    """Page citations in order; sentences of statutes (after §, Art., Abs.) are none. ``f.`` adds the next page, ``ff.`` leaves the end open."""
    out = []
    for m in _PAGE.finditer(text or ""):
        if _STATUTE.search(text[max(0, m.start() - 80) : m.start()]):
            continue
        first = int(m[1])
        last = int(m[2]) if m[2] else first + (m[3] == "f.")
        pages = tuple(range(first, last + 1)) or (first,)
        lo, hi = sentence_at(text, m.start())
        sentence = text[lo:hi].strip()
        claim = re.sub(r"\s+", " ", _PAGE.sub("", re.sub(r"\([^()]*\)", "", sentence))).strip(" .,;")
        out.append(Citation(m.start(), pages, m[3] == "ff.", sentence, claim))
    return out


def extract(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per citation: key, pos, pages, open_end, sentence and claim."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, c.pos, list(c.pages), c.open_end, c.sentence, c.claim) for k, t in zip(batch[key], batch[text], strict=True) for c in find(t)]
            yield pd.DataFrame(rows, columns=["key", "pos", "pages", "open_end", "sentence", "claim"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"key {kind}, pos int, pages array<int>, open_end boolean, sentence string, claim string").withColumnRenamed("key", key)
