"""Replacing a case's names, places and numbers in scanned text, all of them in one pass.

A text is reduced to its *skeleton*: white space and soft hyphens go, letters become lower-case, and characters that scans mix up become one. One
Aho-Corasick automaton over the skeletons of all forms of all terms finds every place where any of them can stand, however
its letters are set apart; what is found is then judged by the blanks between its characters and by its edges. Work is linear in the text, whatever blanks it holds.

Which places are replaced is settled by priority and not by rewriting the text term after term: full names and their order variants first, longer before
shorter, then the words of names; a place that overlaps one already taken is left. A form is looked for letter by letter only if it occurs nowhere as it is.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that scans mix up, titles that are no part of a name, words that are no name by themselves, endings of names.
CONFUSED = ("iIlL1|", "oO0", "bBßẞ8", "zZ2", "sS5")
TITLES = frozenset("herr herrn frau genosse genossin mandant mandantin klient klientin".split())
NO_NAMES = frozenset(
    "hinweis hinweise datum unterschrift untersche apagstellers antragsteller antragstellerin sachbearbeiter unterzeichner regierungsamtsrat urteil asyl asylantrag asylverfahren asylg"
    " quelle quellen sources say killed times putin kampfhandlungen luftangriffe".split()
)
ENDINGS = ("ens", "en", "es", "n", "s")
#: Terms of so many letters and digits are replaced as whole words only, and only letters are mixed up in them.
SHORT = 4
#: Blanks between two letters that are set apart.
GAP = 2


class Kind(NamedTuple):
    """How the terms of one kind are looked for."""

    names: bool = False  # order variants, words of names, endings
    confused: bool = False
    spaced: bool = True  # letters set apart, where a form does not occur as it is
    words: bool = False  # single words as whole words only, whatever their length


KINDS = {"person": Kind(names=True, confused=True), "address": Kind(confused=True), "place": Kind(confused=True, words=True), "number": Kind(spaced=False)}


def _blank(c: str) -> bool:
    return c.isspace() or c == "­"


def _fold_table(confused: bool) -> np.ndarray:
    table = np.arange(0x10000, dtype=np.uint32)
    for k in range(0x10000):
        low = chr(k).lower()
        if len(low) == 1:
            table[k] = ord(low)
    if confused:
        for group in CONFUSED:
            table[[ord(c) for c in group]] = ord(group[0])
    return table


@lru_cache(maxsize=2)
def _folds(confused: bool) -> tuple[np.ndarray, np.ndarray]:
    """The skeleton's character for each of the first plane, and which of them are blanks."""
    return _fold_table(confused), np.array([_blank(chr(k)) for k in range(0x10000)])


def skeleton(text: str, confused: bool) -> tuple[str, np.ndarray]:
    """The skeleton and the place of each of its characters in the text."""
    table, blank = _folds(confused)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes < 0x10000
    at = np.flatnonzero(~(low & blank[np.where(low, codes, 0)]))
    folded = np.where(low, table[np.where(low, codes, 0)], codes)[at]
    return folded.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass"), at


def _one_space(term: str) -> str:
    return " ".join(term.split())


def orders(name: str) -> list[str]:
    """A name and its other order: ``Last, First`` for ``First Last`` and the other way round, without titles."""
    clean = _one_space(name)
    if "," in clean:
        left, right = (p.strip() for p in clean.split(",", 1))
        words = left.split(" ")
        while words and words[0].lower() in TITLES:
            words = words[1:]
        return [clean, f"{right} {' '.join(words)}"] if right and words else [clean]
    words = clean.split(" ")
    while words and words[0].lower() in TITLES:
        words = words[1:]
    if len(words) < 2:
        return [clean]
    # the order is also changed without a comma: `Wu Li` for `Li Wu`
    turned = [f"{words[-1]}, {' '.join(words[:-1])}", f"{words[-1]} {' '.join(words[:-1])}"]
    return [clean, *turned]


def words_of(name: str) -> list[str]:
    """The words of a name of several that are looked for by themselves: of four letters or more, no title, no general word."""
    clean = _one_space(name)
    if " " not in clean and "," not in clean:
        return []
    return [w for w in re.findall(r"[^\W\d_]{4,}", clean) if w.lower() not in TITLES and w.lower() not in NO_NAMES]


class Form(NamedTuple):
    """One form of a term: its characters, where blanks may stand between them, and its rank."""

    shown: str
    free: tuple[bool, ...]  # a gap of any width may follow this character
    loose: tuple[bool, ...]  # so where letters are set apart
    short: bool
    alnum: int
    rank: int


def _form(term: str, rank: int) -> Form:
    shown, free, loose = [], [], []
    for c in term:
        if _blank(c):
            if free:
                free[-1] = loose[-1] = True
            continue
        if c in "-,." and free:
            loose[-1] = True
            free[-1] = free[-1] or c != "."
        shown.append(c)
        free.append(c in "-,")
        loose.append(c in "-,.")
    return Form("".join(shown), tuple(free), tuple(loose), (n := sum(c.isalnum() for c in shown)) <= SHORT, n, rank)


class Terms:
    """The automaton of one list of terms of one kind."""

    def __init__(self, terms: Iterable[str], kind: Kind):
        import ahocorasick

        self.kind = kind
        clean = sorted({unicodedata.normalize("NFC", t).strip() for t in terms if t and len(t.strip()) >= 2}, key=lambda t: (-len(t), t))
        listed = list(dict.fromkeys(v for t in clean for v in (orders(t) if kind.names else [t])))
        if kind.names:
            listed += sorted({w.lower(): w for t in clean for w in words_of(t)}.values(), key=lambda w: (-len(w), w))
        self.forms: list[Form] = []
        by_skeleton: dict[str, list[int]] = {}
        for rank, term in enumerate(t for t in listed if len(t) >= 2):
            form = _form(term, rank)
            if form.shown:
                by_skeleton.setdefault(skeleton(form.shown, kind.confused)[0], []).append(len(self.forms))
                self.forms.append(form)
        self.automaton = ahocorasick.Automaton()
        for key, numbers in by_skeleton.items():
            self.automaton.add_word(key, (len(key), numbers))
        if by_skeleton:
            self.automaton.make_automaton()

    def _edges(self, text: str, form: Form, start: int, end: int, spaced: bool) -> int | None:
        """Where the hit ends, with an ending that belongs to it, or nothing if it stands inside a word where it must not."""
        whole = spaced or form.short or (self.kind.words and form.shown.replace("-", "").isalpha())
        letters = self.kind.words and not spaced and not form.short  # digits beside a place are no part of a word
        inside = (lambda c: c.isalpha()) if letters else (lambda c: c.isalnum())
        if whole and start and inside(text[start - 1]):
            return None
        if self.kind.names and not spaced:
            for ending in ENDINGS:
                to = end + len(ending)
                if text[end:to].lower() == ending and not text[to : to + 1].isalnum():
                    return to
        return None if whole and text[end : end + 1] and inside(text[end]) else end

    def _alike(self, form: Form, text: str, places: np.ndarray) -> bool:
        """In short forms no digit stands for a letter."""
        return not form.short or all(text[p].lower() == c.lower() or (text[p].isalpha() and c.isalpha()) for p, c in zip(places.tolist(), form.shown, strict=True))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Places to replace, in order, none of which overlaps another."""
        if not self.forms or not text:
            return []
        bones, at = skeleton(text, self.kind.confused)
        gaps = np.diff(at) - 1
        plain: dict[int, list[tuple[int, int]]] = {}
        apart: dict[int, list[tuple[int, int]]] = {}
        for last, (size, numbers) in self.automaton.iter(bones):
            first = last - size + 1
            between = gaps[first:last]
            wide = np.flatnonzero(between)
            start, end = int(at[first]), int(at[last]) + 1
            for k in numbers:
                form = self.forms[k]
                if all(form.free[j] for j in wide.tolist()):
                    if self._alike(form, text, at[first : last + 1]) and (to := self._edges(text, form, start, end, spaced=False)) is not None:
                        plain.setdefault(k, []).append((start, to))
                elif self.kind.spaced and form.alnum >= SHORT and not (self.kind.words and form.shown.replace("-", "").isalpha()):
                    if all(form.loose[j] or between[j] <= GAP for j in wide.tolist()) and self._edges(text, form, start, end, spaced=True) is not None:
                        apart.setdefault(k, []).append((start, end))
        taken: list[tuple[int, int]] = []
        for k in sorted({*plain, *apart}, key=lambda k: self.forms[k].rank):
            if not self._take(taken, plain.get(k, [])):
                self._take(taken, apart.get(k, []))
        return taken

    @staticmethod
    def _take(taken: list[tuple[int, int]], found: list[tuple[int, int]]) -> bool:
        hit = False
        for start, end in found:
            k = bisect_left(taken, (start, end))
            if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0]):
                taken.insert(k, (start, end))
                hit = True
        return hit

    def replace(self, text: str, token: str) -> str:
        out, at = [], 0
        for start, end in self.spans(text):
            out += [text[at:start], token]
            at = end
        return "".join(out) + text[at:]


@lru_cache(maxsize=256)
def compiled(terms: tuple[str, ...], kind: str = "person") -> Terms:
    """The automaton of a list; texts of one case share it."""
    return Terms(terms, KINDS[kind])


def replace_terms(text: str, terms: Sequence[str], token: str, kind: str = "person") -> str:
    """``text`` with every place of a term replaced by ``token``.

    Blanks, hyphens and commas of a term may be set in any way; in names, places and addresses characters that scans mix up are one. Names are
    also found in their other order, then by their words of four letters or more. Terms of up to four letters and digits, and single words of kind
    ``place``, are replaced as whole words only, longer ones also inside words; endings of names go with them. A form that occurs nowhere as it is, is looked for with up to two
    blanks between letters (numbers are not). Terms of one character and null ones are left out.
    """
    return compiled(tuple(t for t in terms if t), kind).replace(text, token)


def redact_terms(df: DataFrame, text: str, terms: dict[str, tuple[str, str]], out: str = "redacted", strict: bool = True) -> DataFrame:
    """``df`` with ``out``: column ``text`` without the terms in array columns, by kind in the order given.

    ``terms`` says for each array column its kind and what takes the place of its terms. Null texts stay null, null arrays and terms are
    none. Texts are worked on in Arrow batches; rows of one case share their automata. A text that cannot be worked on fails the job, or with ``strict`` off is null.
    """
    columns = list(terms)

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for texts, *lists in parts:
            cleaned = []
            for value, *own in zip(texts, *lists, strict=True):
                try:
                    for (kind, token), some in zip(terms.values(), own, strict=True):
                        if value is not None and some is not None:
                            value = replace_terms(value, list(some), token, kind)
                except Exception:
                    if strict:
                        raise
                    value = None
                cleaned.append(value)
            yield pd.Series(cleaned)

    return df.withColumn(out, run(text, *columns))


def birth_dates(values: Column) -> Column:
    """A pattern that fits the forms scans give the birth dates of an array: ``12.3.1967`` also as ``2 . 03 . 67`` or ``12.0367``; null without dates."""
    number = lambda v: F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(v.cast("string"), F.lpad(v.cast("string"), 2, "0"), F.when((v >= 10) & (v <= 12), (v % 10).cast("string"))), lambda x: x.isNotNull())), lambda a, b: F.length(b) - F.length(a)), "|")

    def one(value: Column) -> Column:
        part = lambda k: F.regexp_extract(value, r"^\s*(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})\s*$", k)
        year = F.when(F.length(part(3)) == 4, F.concat(part(3), F.lit("|"), F.substring(part(3), 3, 2))).otherwise(part(3))
        apart = r"\s{0,2}[./-]\s{0,2}"
        return F.when(part(3) != "", F.concat(F.lit("(?:"), number(part(1).cast("int")), F.lit(f"){apart}(?:"), number(part(2).cast("int")), F.lit(f")(?:{apart})?(?:"), year, F.lit(")")))

    listed = F.filter(F.transform(values, one), lambda x: x.isNotNull())
    return F.when(F.size(listed) > 0, F.concat(F.lit(r"(?<!\d)(?:"), F.array_join(listed, "|"), F.lit(r")(?!\d)")))


def redact_birth_dates(text: Column, values: Column, token: str = "[GEBURTSDATUM]") -> Column:
    """``text`` without the birth dates of an array, in the forms of :func:`birth_dates`; other dates stay."""
    pattern = birth_dates(values)
    return F.when(pattern.isNull(), text).otherwise(F.regexp_replace(text, pattern, F.lit(token)))
