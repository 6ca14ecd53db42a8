"""Words by their stems, and the rank of texts by how densely they cover a query."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = "aeiouyäöü"
# Letters that an s or st at the end of a German word can follow, and its endings by step.
_BEFORE_S, _BEFORE_ST = "bdfghklmnrt", "bdfghklmnt"
_STEP_1, _STEP_2 = ("ern", "em", "er", "en", "es", "e", "s"), ("est", "en", "er", "st")


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin: behind the first consonant after a vowel, the first one at the fourth letter or later, and once more from there."""
    first = re.search(f"[{_VOWELS}][^{_VOWELS}]", word)
    r1 = first.end() if first else len(word)
    second = re.search(f"[{_VOWELS}][^{_VOWELS}]", word[r1:])
    return max(r1, 3), r1 + second.end() if second else len(word)


@lru_cache(maxsize=1 << 16)
def german_stem(word: str) -> str:
    """The stem of a lower-case German word by the published suffix-stripping algorithm for German."""
    word = word.replace("ß", "ss")
    word = re.sub(f"(?<=[{_VOWELS}])[uy](?=[{_VOWELS}])", lambda m: m[0].upper(), word)
    r1, r2 = _regions(word)

    def ends(*endings: str) -> str:
        return next((e for e in endings if word.endswith(e)), "")

    if (e := ends(*_STEP_1)) and len(word) - len(e) >= r1 and (e != "s" or word[-2:-1] in tuple(_BEFORE_S)):
        word = word[: -len(e)]
        if e in ("e", "en", "es") and word.endswith("niss"):
            word = word[:-1]
    if (e := ends(*_STEP_2)) and len(word) - len(e) >= r1 and (e != "st" or (word[-3:-2] in tuple(_BEFORE_ST) and len(word) >= 6)):
        word = word[: -len(e)]
    if (e := ends("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik")) and len(word) - len(e) >= r2:
        rest = word[: -len(e)]
        if e in ("end", "ung"):
            word = rest
            if word.endswith("ig") and len(word) - 2 >= r2 and word[-3:-2] != "e":
                word = word[:-2]
        elif e in ("ig", "ik", "isch"):
            word = word if rest.endswith("e") else rest
        elif e in ("lich", "heit"):
            word = rest[:-2] if rest.endswith(("er", "en")) and len(rest) - 2 >= r1 else rest
        else:
            more = "lich" if rest.endswith("lich") else "ig" if rest.endswith("ig") else ""
            word = rest[: -len(more)] if more and len(rest) - len(more) >= r2 else rest
    return word.lower().translate(str.maketrans("äöü", "aou"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(lists: pd.Series) -> pd.Series:
    return lists.map(lambda words: None if words is None else [german_stem(w) for w in words])


def stemmed_terms(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """The stems of a text's terms, in order; stop words are taken out before."""
    from .retrieval import terms_of

    return _stems(terms_of(text, stop))


def covers(branches: Sequence[Sequence[np.ndarray]]) -> list[tuple[int, int, int]]:
    """(first, last, terms) of the smallest stretches that hold all terms of one branch and no smaller such stretch.

    A branch has the sorted places of each of its terms; ``terms`` counts the places of any branch's terms in a stretch.
    """
    places = np.unique(np.concatenate([p for b in branches for p in b])) if any(len(b) for b in branches) else np.empty(0, np.int64)
    if not len(places):
        return []
    far = np.iinfo(np.int64).max
    ends = np.full(len(places), far)
    for branch in branches:
        own = np.zeros(len(places), np.int64)
        for at in branch:
            next_ = np.searchsorted(at, places)
            own = np.maximum(own, np.where(next_ < len(at), np.asarray(at, np.int64)[np.minimum(next_, len(at) - 1)] if len(at) else far, far))
        if len(branch):
            ends = np.minimum(ends, own)
    smallest = (ends < far) & (ends < np.append(ends[1:], far))
    # the last place has no later one; places behind the last full stretch have none of their own
    inside = np.searchsorted(places, ends, side="right") - np.arange(len(places))
    return [(int(places[k]), int(ends[k]), int(inside[k])) for k in np.flatnonzero(smallest)]


def cover_rank(branches: Sequence[Sequence[np.ndarray]], weight: float = 0.1) -> float:
    """The sum over covers of ``weight`` / (1 + the other words in between)."""
    return float(sum(weight / (1 + (last - first + 1) - n) for first, last, n in covers(branches)))


@F.pandas_udf(T.DoubleType())
def cover_rank_of(lists: pd.Series) -> pd.Series:
    """:func:`cover_rank` of an array of (branch, of, at): a branch's terms, how many it has, and where each stands; branches that lack a term do not count."""

    def one(rows) -> float:
        held: dict[int, list[np.ndarray]] = {}
        need: dict[int, int] = {}
        for r in rows:
            held.setdefault(r["branch"], []).append(np.asarray(r["at"], np.int64))
            need[r["branch"]] = r["of"]
        return cover_rank([b for k, b in sorted(held.items()) if len(b) == need[k]])

    return lists.map(one)
