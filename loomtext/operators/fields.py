"""Fields taken from free text: case numbers, courts, paragraphs, keywords, printed page numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CASE_NUMBER = r"(?:az|aktenzeichen)\s*[:\-]?\s*([a-z0-9][a-z0-9 ./-]{0,20}/[0-9]{2,4})"
ECLI = r"(ecli:[a-z]{2}:[a-z0-9.\-]+:[0-9]{4}:[a-z0-9_.\-]+)"


def case_numbers(text: Column) -> Column:
    """File numbers and ECLIs in upper case without blanks, each once."""
    t = F.lower(F.coalesce(text, F.lit("")))
    both = F.concat(F.transform(F.regexp_extract_all(t, F.lit(CASE_NUMBER), F.lit(1)), lambda x: F.replace(x, F.lit(" "), F.lit(""))), F.regexp_extract_all(t, F.lit(ECLI), F.lit(1)))
    return F.array_distinct(F.transform(both, F.upper))


def keywords(text: Column, stop: Sequence[str], most: int = 12, least: int = 4) -> Column:
    """The first distinct words of at least ``least`` letters that are no stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-zäöüß]{%d,}" % least), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(*stop))), 1, most)


def first_match(text: Column, table: Sequence[tuple[str, Sequence[str]]], default: str | None = None) -> Column:
    """Name of the first entry one of whose tokens occurs."""
    out: Column = F.lit(default).cast("string")
    for name, tokens in reversed(table):
        hit = F.lit(False)
        for t in tokens:
            hit = hit | text.contains(t)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def printed_pages(pages: DataFrame, key: str, number: str, printed: str, least: int = 3) -> DataFrame:
    """``pages`` with ``folio``: the page numbers as printed, or the own count where the printed ones are no page numbers.

    ``printed`` is null on pages without one. They count if there are ``least`` of them on as many pages, if they rise strictly, and
    if half of their steps are as long as those of the pages. A page without one takes the nearest numbered page's offset, the earlier of two;
    it has no folio where that gives a number below 1 or one that another page has.
    """
    up = Window.partitionBy(key).orderBy(number)
    mark = F.when(F.col(printed).isNotNull(), F.struct(F.col(number).alias("n"), F.col(printed).alias("p")))
    before = F.last(mark, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(mark, ignorenulls=True).over(up.rowsBetween(1, Window.unboundedFollowing))
    held = pages.withColumn("_b", before).withColumn("_a", after)
    every = Window.partitionBy(key)
    step = F.col(printed) - F.col("_b.p")
    pairs = F.count(step).over(every)
    fits = (F.count(F.lit(1)).over(every) >= least) & (pairs + 1 >= least) & (F.count(F.when(step <= 0, 1)).over(every) == 0)
    fits &= F.count(F.when(step == F.col(number) - F.col("_b.n"), 1)).over(every) >= F.greatest(F.lit(1), F.floor(pairs / 2))
    near = F.when(F.col("_a").isNull() | (F.col(number) - F.col("_b.n") <= F.col("_a.n") - F.col(number)), F.col("_b")).otherwise(F.col("_a"))
    held = held.withColumn("_ok", fits).withColumn("_f", F.coalesce(F.col(printed), near["p"] + F.col(number) - near["n"]))
    first = F.row_number().over(Window.partitionBy(key, "_f").orderBy(F.col(printed).isNull(), number)) == 1
    folio = F.when(~F.col("_ok"), F.col(number)).when(F.col(printed).isNotNull() | (first & (F.col("_f") > 0)), F.col("_f"))
    return held.withColumn("folio", folio).drop("_a", "_b", "_ok", "_f")


def scan_form(text: Column) -> Column:
    """Scanned text with its usual flaws mended: joined hyphens, spaced punctuation, doubled blanks, look-alike digits inside numbers."""
    for pattern, to in ((r"([a-zäöüß])-\n([a-zäöüß])", "$1$2"), (r"[ \t]+([,.;:])", "$1"), (r"[ \t]{2,}", " "), (r"([0-9])[oO]([0-9])", "$10$2"), (r"([0-9])[lI]([0-9])", "$11$2")):
        text = F.regexp_replace(text, pattern, to)
    return text
