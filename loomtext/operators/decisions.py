"""Court decisions cited in drafts and sources: parsing, grounding in the text, file numbers, and the match with a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How a decision is cited, and the shapes of its file number in text and in a URL's path.
_COURT = r"(?:BVerwG|BVerfG|EuGH|EGMR|BGH|BSG|BAG|(?:OVG|VGH|VG|LSG|SG|LG|AG)\s+[A-ZÄÖÜ][\p{L}\p{N}_.-]*(?:\s+[A-ZÄÖÜ][\p{L}\p{N}_.-]*)?)"
_KIND = r"(?:Urteil|Beschluss|Gerichtsbescheid)"
_FILE = r"(?:C-\d+/\d+|\d{1,3}\s+[A-Z]{1,3}\s+\d+[./]\d+(?:\.[A-Z]{1,2})?)"
CITED = rf"({_COURT}),\s*({_KIND})\s+vom\s+(\d{{1,2}}\.\d{{1,2}}\.\d{{4}})\s*[–—-]\s*({_FILE})"
FILE_IN_TEXT = r"\b\d{1,4}\s+[A-Za-z]{1,6}\s+\d{1,6}[/.]\d{2,6}\b"
FILE_IN_URL = r"\d{1,4}[-_][A-Za-z]{1,6}[-_]\d{1,6}[-_]\d{2,4}"
MONTHS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")


def _single(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def cited_decisions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, court, kind, date, az) for each decision cited in a text, once for each court and file number, in order."""
    hits = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(CITED), F.lit(0))
    each = df.select(key, F.posexplode(hits).alias("n", "_hit"))
    part = lambda k: F.regexp_extract("_hit", CITED, k)
    each = each.select(key, "n", _single(part(1)).alias("court"), part(2).alias("kind"), part(3).alias("date"), _single(part(4)).alias("az"))
    first = F.row_number().over(Window.partitionBy(key, F.lower("court"), F.lower("az")).orderBy("n"))
    return each.withColumn("_first", first).where("_first = 1").drop("_first")


def file_key(az: Column) -> Column:
    """A file number as it is compared: letters and digits only, lower case."""
    return F.regexp_replace(F.lower(F.coalesce(az, F.lit(""))), r"[^\p{L}\p{N}]", "")


def grounded(az: Column, date: Column, court: Column, text: Column) -> Column:
    """Whether a citation that a model gives stands in the text: its file number, its date in one of three spellings, and its court's first word."""
    d, m, y = (F.regexp_extract(date, r"^(\d{2})\.(\d{2})\.(\d{4})$", k) for k in (1, 2, 3))
    day = d.try_cast("int").cast("string")
    month = F.get(F.array(*map(F.lit, MONTHS)), m.try_cast("int") - 1)
    spelt = (date, F.concat_ws(".", day, m.try_cast("int").cast("string"), y), F.concat(day, F.lit(". "), month, F.lit(" "), y))
    there = F.lit(False)
    for s in spelt:
        there = there | F.coalesce(text.contains(s), F.lit(False))
    word = F.get(F.split(F.trim(court), r"\s+"), F.lit(0))
    return F.coalesce((file_key(az) != "") & file_key(text).contains(file_key(az)) & (y != "") & there & (word != "") & text.contains(word), F.lit(False))


def file_hint(given: Column, text: Column, url: Column) -> Column:
    """The file number of a web source: the one given, else the first in its text, else one in its URL's path put into its usual form, else empty."""
    said = F.regexp_extract(F.regexp_replace(text, r"\s+", " "), FILE_IN_TEXT, 0)
    parts = F.split(F.regexp_extract(F.coalesce(F.try_url_decode(url), url), FILE_IN_URL, 0), "[-_]")
    path = F.concat(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), " "), F.lit("/"), F.element_at(parts, -1))
    none = lambda c: F.when(c != "", c)
    return F.coalesce(none(F.trim(given)), none(said), F.when(F.size(parts) >= 3, path), F.lit(""))


def mark_known(sources: DataFrame, store: DataFrame, az: str, store_az: str) -> DataFrame:
    """``sources`` with ``known``: whether the store has a decision of that file number."""
    keys = store.select(file_key(F.col(store_az)).alias("_k")).where("_k <> ''").distinct().withColumn("_known", F.lit(True))
    return sources.withColumn("_k", file_key(F.col(az))).join(keys, "_k", "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_k", "_known")


def verify_first(sources: DataFrame, group: str, position: str, hint: str, most: int = 8) -> DataFrame:
    """``sources`` with ``turn``: the number of the first ``most`` with a file number in each group, which are sent to be verified; null for the rest."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy((F.col(hint) == "").cast("int"), position))
    return sources.withColumn("turn", turn).withColumn("turn", F.when((F.col(hint) != "") & (F.col("turn") <= most), F.col("turn")))
