"""Web sources: URLs, visible text, page classes, ranking with court diversity; ``pages`` plays the search results."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking as K
from ..sources import links as LK
from ..sources.tables import table
from .registry import query

_BLANK = r"[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]"
_TRIM = r"regexp_replace(trim(url), '[).,;]+$', '')"
_U = f"regexp_replace({_TRIM}, '#.*$', '')"
_CANON = rf"""(lower(regexp_extract({_U}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_replace(lower(regexp_extract({_U}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^www\.', '')
 || regexp_extract({_U}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) || coalesce('?' || nullif(array_to_string(list_transform(list_filter(list_transform(list_filter(string_split(regexp_extract({_U}, '\?(.*)$', 1), '&'), lambda p: p <> ''),
 lambda p: [url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' ')), url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' '))]), lambda p: NOT regexp_matches(lower(p[1]), '^(utm_|gclid|fbclid|mc_|ref|source)')),
 lambda p: replace(url_encode(p[1]), '%20', '+') || '=' || replace(url_encode(p[2]), '%20', '+')), '&'), ''), ''))"""
_PART = lambda k: rf"regexp_extract(regexp_replace(trim(url), '#.*$', ''), '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?]*))?([^?]*)(\?.+)?', {k})"
_HOST = rf"regexp_replace(lower({_PART(2)}), '^www\.', '')"
_IDENT = f"(CASE WHEN lower({_PART(1)}) IN ('https', '') THEN regexp_replace({_HOST}, ':443$', '') WHEN lower({_PART(1)}) = 'http' THEN regexp_replace({_HOST}, ':80$', '') ELSE {_HOST} END || regexp_replace({_PART(3)}, '/+$', '') || {_PART(4)})"
_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_KEY = f"substr(trim(regexp_replace(lower({_TITLE}), '[^a-z0-9äöüß]+', ' ', 'g')), 1, 160)"
# every name of HTML 5, the ampersand's last
_NAMED = "[" + ", ".join(f"{{'n': '&{n}', 'c': '{v.replace(chr(39), chr(39) * 2)}'}}" for n, v in sorted(html5.items()) if n.endswith(";") and n.lower() != "amp;") + "]"
_STRIPPED = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
_DECODED = f"replace(replace(list_reduce(list_prepend({{'n': {_STRIPPED}, 'c': ''}}, {_NAMED}), lambda a, e: {{'n': replace(a.n, e.n, e.c), 'c': ''}}).n, '&#39;', chr(39)), '&amp;', '&')"
_TEXT = f"regexp_replace(regexp_replace({_DECODED}, '{_BLANK}+', ' ', 'g'), '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _pages(spark, d):
    return table(spark, d, "pages").withColumn("title", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))


@query("canonical_urls", f"SELECT page_id, {_CANON} AS canonical FROM pages")
def canonical_urls(spark, d):
    return table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@query("citation_urls", f"SELECT page_id, {_IDENT} AS identity FROM pages")
def citation_urls(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_identity(F.col("url")).alias("identity"))


@query("title_keys", f"SELECT page_id, {_KEY} AS title_key FROM pages")
def title_keys(spark, d):
    return _pages(spark, d).select("page_id", T.title_key(F.col("title")).alias("title_key"))


# every reference decoded once, from left to right: by number, by name, or by one of the names that need no semicolon, the longest
_LITERAL = lambda v: "'" + v.replace("'", "''") + "'"
_NAMES = ", ".join(f"({_LITERAL(n)}, {_LITERAL(v)})" for n, v in sorted(html5.items()))
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_SHOWN = ", ".join(_LITERAL(bytes([k]).decode("cp1252", "ignore") or chr(k)) for k in range(0x80, 0xA0))
_VISIBLE = rf"""WITH n(name, c) AS (VALUES {_NAMES}),
s AS (SELECT row_number() OVER () AS r, page_id, string_split({_STRIPPED}, '&') AS ps FROM pages),
e AS (SELECT r, page_id, i, ps[i] AS p FROM s, unnest(range(1, coalesce(len(ps), 1) + 1)) AS u(i)),
k AS (SELECT *, coalesce(nullif(regexp_extract(p, '^#([0-9]{{1,10}})', 1), ''), '0x' || nullif(regexp_extract(p, '^#[xX]([0-9a-fA-F]{{1,8}})', 1), ''))::BIGINT AS code,
 regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*;)', 1) AS named, regexp_extract(p, '^({_BARE})', 1) AS bare FROM e),
d AS (SELECT r, page_id, i, CASE WHEN i = 1 THEN p
 WHEN code IS NOT NULL THEN CASE WHEN code = 0 OR code BETWEEN 55296 AND 57343 OR code > 1114111 THEN chr(65533) WHEN code BETWEEN 128 AND 159 THEN [{_SHOWN}][code - 127] ELSE chr(code::INT) END || regexp_replace(p, '^#([0-9]{{1,10}}|[xX][0-9a-fA-F]{{1,8}});?', '')
 WHEN a.c IS NOT NULL THEN a.c || substr(p, length(named) + 1) WHEN b.c IS NOT NULL THEN b.c || substr(p, length(bare) + 1) ELSE '&' || p END AS x FROM k LEFT JOIN n a ON named = a.name LEFT JOIN n b ON bare = b.name),
t AS (SELECT page_id, string_agg(x, '' ORDER BY i) AS x FROM d GROUP BY r, page_id)
SELECT page_id, md5(x) AS text_md5, length(x)::BIGINT AS chars FROM (SELECT page_id, regexp_replace(regexp_replace(x, '{_BLANK}+', ' ', 'g'), '^{_BLANK}+|{_BLANK}+$', '', 'g') AS x FROM t)"""


@query("visible_text", _VISIBLE)
def visible_text(spark, d):
    t = table(spark, d, "pages").select("page_id", T.visible_text(F.col("html")).alias("t"))
    return t.select("page_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("chars"))


@query("page_links", "SELECT page_id, link, count(*) AS n FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) AS ls FROM pages), unnest(ls) AS t(link) GROUP BY ALL")
def page_links(spark, d):
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link")
    return table(spark, d, "pages").select("page_id", links).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


_IDS = r"""SELECT page_id, regexp_replace(regexp_replace(h, '#.*$', ''), '^/+|/+$', '', 'g') AS target, k FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1) AS hs FROM pages), unnest(hs) WITH ORDINALITY AS t(h, k) WHERE h LIKE '/%'"""
_LINKS = rf"""i AS ({_IDS}), n AS (SELECT page_id, target AS name FROM i WHERE k = 1), l AS (SELECT name AS a, target AS b FROM n JOIN i USING (page_id) WHERE target <> '' AND target NOT LIKE '\_%' ESCAPE '\' AND NOT contains(target, '..'))"""


@query("discovered_pages", f"WITH RECURSIVE {_LINKS}, r AS (SELECT DISTINCT name AS page, 0 AS depth FROM n WHERE page_id % 50 = 0 UNION SELECT b, depth + 1 FROM r JOIN l ON a = page WHERE depth < 6) SELECT page, min(depth) AS depth FROM r GROUP BY page")
def discovered_pages(spark, d):
    """What every fiftieth page reaches over up to six links; a page stands under the id that its first link names."""
    p = table(spark, d, "pages").select("page_id", LK.hrefs(F.col("html")).alias("hs"))
    ids = p.select("page_id", LK.page_id(F.get("hs", F.lit(0)), "http://site.test").alias("name"), F.explode("hs").alias("h")).select("page_id", "name", LK.page_id(F.col("h"), "http://site.test").alias("target"))
    return LK.discovered(ids, ids.where("page_id % 50 = 0").select(F.col("name").alias("page")), "name", "target", 6)


@query("pdf_links", "SELECT page_id, regexp_extract(html, 'href=\"([^\"]+\\.pdf)\"', 1) AS pdf FROM pages")
def pdf_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", r'href="([^"]+\.pdf)"', 1).alias("pdf"))


@query("page_classes", f"""SELECT page_id, CASE WHEN st IN (404, 410) THEN 'notfound' WHEN st IN (401, 403, 407, 429, 451) THEN 'blocked' WHEN st >= 400 THEN 'error'
 WHEN regexp_matches(t, '[0-9]+') AND (contains(t, 'and') OR contains(t, 'de ')) AND length(t) >= 200 THEN 'ok' WHEN length(t) < 1500 THEN 'blocked' ELSE 'not_decision' END AS class
FROM (SELECT page_id, [200, 200, 200, 404, 403, 500][1 + page_id % 6] AS st, {_TEXT} AS t FROM pages)""")
def page_classes(spark, d):
    """Classes of fetched pages from status and visible text; the status follows from the id."""
    status = F.element_at(F.array(*map(F.lit, (200, 200, 200, 404, 403, 500))), (F.col("page_id") % 6 + 1).cast("int"))
    p = table(spark, d, "pages").select("page_id", status.alias("st"), T.visible_text(F.col("html")).alias("t"))
    st, t = F.col("st"), F.col("t")
    found = t.rlike("[0-9]+") & (t.contains("and") | t.contains("de ")) & (F.length(t) >= 200)
    cls = F.when(st.isin(404, 410), "notfound").when(st.isin(401, 403, 407, 429, 451), "blocked").when(st >= 400, "error").when(found, "ok").when(F.length(t) < 1500, "blocked").otherwise("not_decision")
    return p.select("page_id", cls.alias("class"))


@query("needs_recognition", f"SELECT page_id, length(regexp_replace({_TEXT}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 500 AS needs FROM pages")
def needs_recognition(spark, d):
    t = T.visible_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", (F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")) < 500).alias("needs"))


@query("deduped_sources", f"SELECT min(page_id) AS page_id, {_CANON} AS canonical FROM pages GROUP BY {_CANON}, {_KEY}")
def deduped_sources(spark, d):
    return K.dedupe(_pages(spark, d).select("page_id", "url", "title"), "url", "title", "page_id").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


#: A profile for the synthetic pages: hosts stand in for courts.
POLICY = K.Policy(terms=("tion", "/en/"), official=(".example.org",), off_topic=("blog.",), law_text=("/fr/",), decision=("the", "der"), court=("m.", "www."), buckets=(("bverwg", ("example.net",)), ("bverfg", ("m.",)), ("ovg", ("example.org",))), off_topic_penalty=220, law_text_penalty=340, undated_penalty=30)
_SCORED = rf"""b AS (SELECT page_id, url, lower(url || ' ' || {_TITLE} || ' ') AS t FROM pages),
y AS (SELECT *, list_max(list_transform(regexp_extract_all(t, '((?:19|20)[0-9]{{2}}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}|[0-9]{{1,2}}[./][0-9]{{1,2}}[./](?:19|20)[0-9]{{2}})', 1), lambda x: regexp_extract(x, '((?:19|20)[0-9]{{2}})', 1)::INT)) AS dy,
 list_transform(regexp_extract_all(t, '(?:^|[^0-9A-Za-z_])((?:19|20)[0-9]{{2}})\b', 1), lambda x: x::INT) AS ys FROM b),
z AS (SELECT *, coalesce(dy, list_max(list_filter(ys, lambda v: v <= 2027)), list_max(ys), 0) AS year FROM y),
s AS (SELECT page_id, url, year, 25 * (contains(t, 'tion')::INT + contains(t, '/en/')::INT) + 65 * contains(t, '.example.org')::INT - 220 * contains(t, 'blog.')::INT - 340 * contains(t, '/fr/')::INT
 + 10 * (contains(t, 'the')::INT + contains(t, 'der')::INT) + 10 * (contains(t, '/entscheid') OR contains(t, '/urteil'))::INT + least(8 * (contains(t, 'm.')::INT + contains(t, 'www.')::INT), 24) + 6 * contains(lower(url), '.pdf')::INT - 30 * (year = 0)::INT AS score,
 CASE WHEN year > 0 THEN greatest(0, year - 2020) + CASE WHEN year >= 2026 THEN 8 ELSE 0 END ELSE 0 END AS recency,
 CASE WHEN contains(t, 'example.net') THEN 'bverwg' WHEN contains(t, 'm.') THEN 'bverfg' WHEN contains(t, 'example.org') THEN 'ovg' ELSE 'other' END AS bucket FROM z)"""


def _scored(spark, d):
    p = _pages(spark, d).select("page_id", "url", "title", F.lit("").alias("description"))
    return K.score(p, POLICY, 2026)


@query("scored_sources", f"WITH {_SCORED} SELECT page_id, score::BIGINT AS score, recency::BIGINT AS recency, year::BIGINT AS year, bucket FROM s")
def scored_sources(spark, d):
    return _scored(spark, d).select("page_id", *(F.col(c).cast("long").alias(c) for c in ("score", "recency", "year")), "bucket")


@query("diverse_sources", f"""WITH {_SCORED}, g AS (SELECT *, page_id % 20 AS request FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY request, bucket ORDER BY score DESC, recency DESC, url DESC) - 1 AS n,
 CASE WHEN max(CASE WHEN bucket NOT IN ('other', 'bverwg') THEN 1 ELSE 0 END) OVER (PARTITION BY request) = 1 THEN 1 ELSE 2 END AS free FROM g),
a AS (SELECT *, score - CASE WHEN bucket IN ('bverwg', 'bverfg') AND n >= free THEN 44 * (n - free + 1) WHEN bucket <> 'other' AND n >= 2 THEN 28 * (n - 1) ELSE 0 END AS adjusted FROM n)
SELECT request, page_id, adjusted::BIGINT AS adjusted, place FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY adjusted DESC, recency DESC, url DESC) AS place FROM a) WHERE place <= 10""")
def diverse_sources(spark, d):
    """Top ten of each request after the diversity penalty."""
    s = _scored(spark, d).withColumn("request", F.col("page_id") % 20)
    out = K.diversify(s, POLICY, ["request"], "url").where("place <= 10")
    return out.select("request", "page_id", F.col("adjusted").cast("long").alias("adjusted"), "place")


@query("decisions_first", f"""WITH {_SCORED}, c AS (SELECT *, contains(url, '/fr/') AS law FROM s), m AS (SELECT *, bool_or(NOT law) OVER (PARTITION BY page_id % 20) AS others FROM c)
SELECT page_id % 20 AS request, page_id, row_number() OVER (PARTITION BY page_id % 20 ORDER BY score DESC, page_id) AS place FROM m WHERE NOT law OR NOT others""")
def decisions_first(spark, d):
    """Law texts stay only where a request has nothing else."""
    s = _scored(spark, d).withColumn("request", F.col("page_id") % 20).withColumn("law", F.col("url").contains("/fr/"))
    m = s.withColumn("others", F.max(~F.col("law")).over(Window.partitionBy("request"))).where(~F.col("law") | ~F.col("others"))
    return m.select("request", "page_id", F.row_number().over(Window.partitionBy("request").orderBy(F.col("score").desc(), "page_id")).alias("place"))


@query("gated_sources", f"SELECT page_id FROM pages WHERE {_IDENT} IN (SELECT {_IDENT} FROM pages WHERE page_id % 3 = 0)")
def gated_sources(spark, d):
    """Sources among the retrieved citations, compared by URL identity."""
    p = table(spark, d, "pages").select("page_id", T.url_identity(F.col("url")).alias("k"))
    return p.join(p.where("page_id % 3 = 0").select("k").distinct(), "k", "left_semi").select("page_id")


@query("relevant_sources", f"""WITH {_SCORED}, k AS (SELECT page_id, page_id % 20 AS request, bucket, year, score, score >= 60 AS keep FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY request, bucket, year ORDER BY keep DESC, score DESC, page_id) AS n FROM k),
f AS (SELECT *, bool_or(keep) OVER (PARTITION BY request) AS has_kept FROM o WHERE n = 1) SELECT request, page_id, place FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, year DESC, bucket, page_id) AS place FROM f WHERE keep OR NOT has_kept) WHERE has_kept OR place <= 3""")
def relevant_sources(spark, d):
    """One source per piece of evidence, those worth keeping, else the best three."""
    s = _scored(spark, d).select("page_id", (F.col("page_id") % 20).alias("request"), "bucket", "year", "score", (F.col("score") >= 60).alias("keep"))
    w = Window.partitionBy("request", "bucket", "year").orderBy(F.col("keep").desc(), F.col("score").desc(), "page_id")
    one = s.withColumn("n", F.row_number().over(w)).where("n = 1").withColumn("some", F.max("keep").over(Window.partitionBy("request")))
    place = F.row_number().over(Window.partitionBy("request").orderBy(F.col("score").desc(), F.col("year").desc(), "bucket", "page_id"))
    return one.where("keep or not some").withColumn("place", place).where("some or place <= 3").select("request", "page_id", "place")
