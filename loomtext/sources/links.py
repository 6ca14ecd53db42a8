"""Which pages a site has, by its links: hrefs, the page ids they name, and what can be reached."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut

# Paths that are no pages, endings of files that are none, and folders under which a page is also served.
NO_PAGE = ("_", "lib/", "feed.php", "doku.php", "validator.", "http://", "https://", "mailto:", "#")
NO_PAGE_END = (".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico")
SERVED_AS = ("_export/raw/", "_export/xhtml/")


def hrefs(html: Column) -> Column:
    """The targets of all links of a page, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), F.lit(1)), lambda h: F.replace(F.regexp_replace(h, "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&")))


def page_id(href: Column, base: str) -> Column:
    """The page of the site at ``base`` that a link names, or null.

    Links may be absolute, start at the host, or be relative to ``base``. Another host, an action other than the index, files, the site's own
    paths and ``..`` are no pages; a link without a path names its page in the query's ``id``.
    """
    host = base.split("://", 1)[-1].split("/", 1)[0]
    below = ("/" + base.split("://", 1)[-1].partition("/")[2].strip("/")).rstrip("/") + "/"

    def decoded(c: Column) -> Column:
        return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)

    def trimmed(c: Column) -> Column:
        return F.nullif(F.regexp_replace(F.trim(c), "^/+|/+$", ""), F.lit(""))

    def parts(h: Column) -> Column:
        whole = F.regexp_extract(h, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)
        rest = F.regexp_replace(h, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*|#.*$", "")
        path = F.regexp_extract(rest, r"^([^?]*)", 1)
        # a path that does not begin at the host begins at the base
        path = F.when((whole == "") & path.rlike("^[^/]"), F.concat(F.lit(below), path)).otherwise(path)
        query = F.regexp_extract(rest, r"\?(.*)$", 1)
        named = F.coalesce(F.try_url_decode(F.regexp_extract(query, r"(?:^|&)id=([^&]*)", 1)), F.lit(""))
        page = F.coalesce(trimmed(F.regexp_replace(decoded(path), rf"^/*(?:{'|'.join(SERVED_AS)})?", "")), trimmed(named))
        fits = F.lower(F.regexp_extract(h, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)).isin("", "http", "https") & whole.isin("", host) & F.regexp_extract(query, r"(?:^|&)do=([^&]*)", 1).isin("", "index")
        return F.named_struct(F.lit("page"), page, F.lit("fits"), fits)

    quoted = lambda words: "|".join(re.escape(w) for w in words)
    no_page = rf"^(?:{quoted(NO_PAGE)})|(?:{quoted(NO_PAGE_END)})$|\.\."
    # bound once, as an expression would otherwise be repeated wherever it is named
    held = F.get(F.transform(F.array(href), parts), F.lit(0))
    return F.get(F.transform(F.array(held), lambda x: F.when(x["fits"] & ~x["page"].rlike(no_page), x["page"])), F.lit(0))


def namespace(page: Column) -> Column:
    """The first part of a page id before a colon, or nothing."""
    return F.when(F.contains(page, F.lit(":")), F.substring_index(page, ":", 1)).otherwise("")


def discovered(links: DataFrame, seeds: DataFrame, source: str, target: str, depth: int, skip: Sequence[str] = ()) -> DataFrame:
    """(page, depth): what can be reached from ``seeds`` (page) over at most ``depth`` links, with the least number of them.

    Pages of the namespaces in ``skip`` are not reached. Each round joins the frontier with the links, takes the pages that no
    round had before, and keeps them in the checkpoint folder; it ends early when nothing is new. Null pages are left out.
    """
    allowed = ~namespace(F.col("page")).isin(list(skip)) if skip else F.lit(True)
    edges = links.select(F.col(source).alias("_from"), F.col(target).alias("page")).where(F.col("page").isNotNull() & allowed)
    frontier = cut(seeds.select("page").where(F.col("page").isNotNull() & allowed).distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    for k in range(1, depth + 1):
        # the links of a page that many link to are followed once
        new = edges.join(frontier.select(F.col("page").alias("_from")), "_from", "left_semi").select("page").distinct()
        frontier = cut(new.join(seen, "page", "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
