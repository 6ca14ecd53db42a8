"""Splitting texts into paragraphs, windows, pages, sections and packed chunks, and putting them together again."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.tables import spread

#: Characters of text after which a task of :func:`split_rows` hands on what it has made.
PART = 4 << 20


def paragraphs(df: DataFrame, text: str, least: int = 10) -> DataFrame:
    """One row per paragraph of at least ``least`` characters, numbered from 0 within the text."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\s*\n+"), strip), lambda p: F.length(p) >= least)
    # outer, as the optimizer would otherwise test the parts before and make them twice
    return df.select("*", F.posexplode_outer(parts).alias("idx", "paragraph")).where(F.col("idx").isNotNull())


def token_windows(df: DataFrame, text: str, size: int = 500, overlap: int = 100, least: int = 80) -> DataFrame:
    """Sliding windows of white-space tokens; the window that reaches the end is the last, short ones are dropped."""
    step = size - overlap
    tokens = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda t: t != "")
    # the windows of a text are made as one array, so that no row carries all tokens
    cut = F.transform(
        F.sequence(F.lit(0), F.when(F.size("_tokens") <= size, 0).otherwise(F.ceil((F.size("_tokens") - size) / step).cast("int"))),
        lambda k: F.struct(k.alias("idx"), F.array_join(F.slice("_tokens", k * step + 1, F.lit(size)), " ").alias("chunk"), F.least(F.lit(size), F.size("_tokens") - k * step).alias("n_tokens")),
    )
    # outer: from a plain inline the optimizer infers a condition on the windows, which it pushes to where the tokens are not made yet, and
    # so splits the text again for each window. A text without tokens has one window of none
    held = df.withColumn("_tokens", tokens).withColumn("_cut", cut).drop("_tokens")
    return held.select(*df.columns, F.inline_outer("_cut")).where(F.col("n_tokens") >= max(least, 1))


def fixed_windows(text: Column, width: int, most: int | None = 24) -> Column:
    """Array of the text's consecutive windows of ``width`` characters, ``most`` at most; None is no cap.

    Without a cap they come from one pass: each ``substring`` would count from the text's beginning.
    """
    if most is None:
        return F.coalesce(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % width), F.lit(0)), F.array().cast("array<string>"))
    n = F.least(F.ceil(F.length(text) / width).cast("int"), F.lit(most))
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.substring(text, k * width + 1, F.lit(width)))
    return F.when(n > 0, each).otherwise(F.array().cast("array<string>"))


def pages(df: DataFrame, text: str) -> DataFrame:
    """One row per page, numbered from 1: form feeds split, else header lines ``--- Page n ---`` or ``--- Seite n ---`` do."""
    header = r"(?m)^--- (?:Page|Seite) \d+ ---[ \t]*\n?"
    c = F.coalesce(F.col(text), F.lit(""))
    by_header = F.split(c, header)
    by_header = F.when(F.get(by_header, F.lit(0)) == "", F.slice(by_header, F.lit(2), F.greatest(F.size(by_header) - 1, F.lit(1)))).otherwise(by_header)
    parts = F.when(c.contains("\f"), F.split(c, "\f")).when(c.rlike(header), by_header).otherwise(F.array(c))
    return df.select("*", F.posexplode(parts).alias("_p", "page_text")).withColumn("page_no", F.col("_p") + 1).drop("_p")


def joined(df: DataFrame, keys: list[str], order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Texts of a key put together in order, with their number and total length."""
    held = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(held, lambda x: x["t"]), separator).alias("text"), F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars"))


def chunk_id(prefix: str, text: Column, idx: Column, width: int = 3) -> Column:
    """Content-addressed id: prefix, 16 digits of the text's hash, number."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(text, 256), 1, 16), F.lit("-"), F.lpad(idx.cast("string"), width, "0"))


def until_budget(df: DataFrame, keys: list[str], order: str, text: str, budget: int) -> DataFrame:
    """Rows of each key in order through the first that reaches the budget of characters."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_before", F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))).where(F.col("_before") < budget).drop("_before")


def _grouped(parts: list[tuple[str, bool]], target: int, glue: str) -> list[str]:
    """Parts joined while they stay within ``target``; a part that stands alone takes no neighbour.

    A running fold over lengths gives every part the number of its chunk; a chunk's length is set to infinity where nothing may follow.
    """

    def place(held: tuple[int, float], part: tuple[str, bool]) -> tuple[int, float]:
        (number, size), (text, alone) = held, part
        if not alone and size + len(glue) + len(text) <= target:
            return number, size + len(glue) + len(text)
        return number + 1, math.inf if alone else len(text)

    numbers = [n for n, _ in accumulate(parts, place, initial=(0, math.inf))][1:]
    return [glue.join(text for (text, _), _ in run) for _, run in groupby(zip(parts, numbers, strict=True), key=lambda x: x[1])]


def _slabs(piece: str, most: int, spaced: bool) -> list[tuple[str, bool]]:
    """A piece cut to ``most`` characters, at a space in the later half of a slab if ``spaced``; all but the rest stand alone."""
    out, lo = [], 0
    while len(piece) - lo > most:
        space = piece.rfind(" ", lo + most // 2 + 1, lo + most) if spaced else -1
        hi = space if space >= 0 else lo + most
        out.append((piece[lo:hi].strip(), True))
        lo = hi
        while spaced and lo < len(piece) and piece[lo].isspace():
            lo += 1
    return [*out, (piece[lo:], False)] if piece[lo:] else out


def pack(text: str, target: int = 1800, most: int = 2400, tail: int = 200) -> list[str]:
    """Paragraphs packed up to ``target`` characters; longer ones than ``most`` are cut at a late space, a short last chunk joins the one before."""
    pieces = filter(None, map(str.strip, re.split(r"\n\s*\n", text)))
    out = _grouped([slab for p in pieces for slab in _slabs(p, most, True)], target, "\n\n")
    return [*out[:-2], "\n\n".join(out[-2:])] if len(out) > 1 and len(out[-1]) < tail else out


def pack_lines(text: str, target: int = 1800, most: int = 2400) -> list[str]:
    """Lines packed up to ``target`` characters; longer ones than ``most`` are cut hard. A blank rest is no chunk, an empty text is one empty chunk."""
    out = _grouped([slab for line in text.split("\n") for slab in (_slabs(line, most, False) or [("", False)])], target, "\n")
    if out:
        out[-1:] = [out[-1].strip()] if out[-1].strip() else []
    return out or [""]


def pack_pages(text: str, most: int, marker: str = r"--- Seite \d+ ---") -> list[str]:
    """Parts of about ``most`` characters that begin at page markers; a text without two such parts is cut at blank lines.

    A block longer than ``most`` is cut hard.
    """
    if len(text) <= most:
        return [text]
    hard = lambda block: [(x, True) for k in range(0, len(block), most) if (x := block[k : k + most].strip())] if len(block) > most else [(block, False)]
    blocks = [b.strip() for b in re.split(f"(?={marker})", text)]
    # the glue after the last part counts as well
    by_page = _grouped([x for b in blocks if b for x in hard(b)], most - 2, "\n\n")
    if len(by_page) > 1 and len(blocks) > 1:
        return by_page
    return [x for c in _grouped([x for b in text.split("\n\n") for x in (hard(b) if len(b) + 2 > most else [(b, False)])], most - 2, "\n\n") if (x := c.strip())]


def seek_split(text: str, most: int, least_share: float = 0.55) -> list[str]:
    """Parts of at most ``most`` characters, ended before a blank line, else before a sentence's end, in the later part of the span, else hard.

    The places where a text may end are listed once; each part takes the last one in its span.
    """
    text = text.strip()
    ends = [[m.start() for m in re.finditer(mark, text)] for mark in (r"(?=\n\n)", r"(?=\. )")]
    out, lo = [], 0
    while len(text) - lo > most:
        floor = lo + int(most * least_share)
        last = [e[k - 1] if (k := bisect_right(e, lo + most - 2)) else -1 for e in ends]
        hi = next((at for at in last if at >= floor), lo + most)
        out.append(text[lo:hi].strip())
        lo = hi + len(text[hi:]) - len(text[hi:].lstrip())
    return [x for x in [*out, text[lo:].strip()] if x]


_HEADING = re.compile(r"(?m)^(#{1,6})[ \t]+(\S.*?)[ \t]*$")


def section_paths(markdown: str, title: str = "") -> list[tuple[str, str]]:
    """(path of headings, body) for each section of a text with ``#`` headings; empty bodies are left out.

    The page's title leads the path unless the first heading is the title itself; what comes before any heading is under it.
    """
    marks = list(_HEADING.finditer(markdown))
    ends = [m.start() for m in marks] + [len(markdown)]
    open_: list[str | None] = [None] * 7  # the heading in force at each level
    out = [(title, markdown[: ends[0]].strip())]
    for m, end in zip(marks, ends[1:], strict=True):
        level = len(m[1])
        open_[level:] = [m[2], *[None] * (6 - level)]
        names = [x for x in open_ if x is not None]
        if title and names[0].casefold() != title.casefold():
            names.insert(0, title)
        out.append((" > ".join(names), markdown[m.end() : end].strip()))
    return [x for x in out if x[1]]


def split_rows(df: DataFrame, key: str, text: str, splitter, schema_key: str = "long") -> DataFrame:
    """One row (key, idx, chunk) for each part that a Python splitter makes of a text; parts leave a task as soon as their texts fill ``PART`` characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for k, t in zip(batch[key], batch[text], strict=True):
                rows += [(k, i, c) for i, c in enumerate(splitter(t or ""))]
                held += len(t or "")
                if held > PART:
                    yield pd.DataFrame(rows, columns=["key", "idx", "chunk"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["key", "idx", "chunk"])

    return spread(df.select(key, text), key).mapInPandas(run, f"key {schema_key}, idx int, chunk string").withColumnRenamed("key", key)
