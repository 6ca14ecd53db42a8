"""Queries on gates, letters, file numbers, sources of a case, proposals and reports. Inputs are made by one expression that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import identity as I
from ..operators import inventory as V
from ..operators import memory as M
from ..operators import privacy as A
from ..operators import ranking as K
from ..operators import residue as Z
from ..sources import sinks as S
from ..sources.tables import table
from .registry import query
from .web import _CANON

_CAT = "CASE p_partkey % 6 WHEN 0 THEN 'Rechtsprechung (neu)' WHEN 1 THEN 'Mandantenunterlagen' WHEN 2 THEN 'Vorinstanz' WHEN 3 THEN 'Sonstige gespeicherte Quellen' WHEN 4 THEN 'Akte' END"
_KIND = "CASE p_size % 5 WHEN 0 THEN ' Photo_Evidence' WHEN 1 THEN 'Letter ' WHEN 2 THEN 'form' WHEN 3 THEN 'court_order' END"
_SIZE = "CASE WHEN p_size % 7 > 0 THEN p_size % 7 END"


@query("segment_gates", f"""SELECT p_partkey, n IS NOT NULL AND n > 1 AND (c IS NULL OR lower(c) NOT LIKE '%rechtsprechung%') AS split, k IS NULL OR lower(trim(k)) <> 'photo_evidence' AS read,
coalesce(c IN ('Mandantenunterlagen', 'Vorinstanz') OR (c LIKE 'Sonstige%' AND lower(trim(k)) IN ('letter', 'form')), false) AS anonymise FROM (SELECT p_partkey, {_CAT} AS c, {_KIND} AS k, {_SIZE} AS n FROM part)""")
def segment_gates(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr(_CAT).alias("c"), F.expr(_KIND).alias("k"), F.expr(_SIZE).alias("n"))
    return p.select("p_partkey", G.may_segment(F.col("n"), F.col("c")).alias("split"), G.may_read(F.col("k")).alias("read"), G.must_anonymise(F.col("c"), F.col("k")).alias("anonymise"))


@query("complete_facets", "SELECT p_partkey, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_size % 4 <> 0 AND p_size % 5 <> 0 AS complete FROM part")
def complete_facets(spark, d):
    """Country, norms, themes and profile, each of them missing or empty in some rows."""
    k, n, one = F.col("p_partkey"), F.col("p_size"), F.array(F.lit("x"))
    country = F.when(k % 2 == 0, F.col("p_brand")).otherwise(F.when(k % 7 == 0, ""))
    parts = F.when(k % 3 != 0, one), F.when(n % 4 != 0, one).otherwise(F.array().cast("array<string>")), F.when(n % 5 != 0, one)
    return table(spark, d, "part").select("p_partkey", G.facets_complete(country, *parts).alias("complete"))


_DRAFT = "CASE c_custkey % 5 WHEN 0 THEN 'Laut Aktennotiz vom Mai' WHEN 1 THEN 'zwei notizen liegen vor' WHEN 2 THEN 'siehe TRANSKRIPT, Blatt ' || c_nationkey WHEN 3 THEN 'Vermerk ' || c_nationkey || '.pdf' END"


@query("note_warnings", f"SELECT c_custkey, coalesce(t, '') LIKE '%Aktennotiz%' OR coalesce(t, '') LIKE '%TRANSKRIPT%' AS speaks, CASE WHEN coalesce(t, '') LIKE '%Vermerk 7.pdf%' THEN 'Vermerk 7.pdf' ELSE '' END AS named FROM (SELECT c_custkey, {_DRAFT} AS t FROM customer)")
def note_warnings(spark, d):
    t = F.expr(_DRAFT)
    named = F.array_join(G.named_notes(t, F.array(F.lit(" Vermerk 7.pdf "), F.lit(""))), ",")
    return table(spark, d, "customer").select("c_custkey", G.names_notes(t).alias("speaks"), named.alias("named"))


_LAW = "CASE WHEN c_custkey % 4 = 0 THEN 'AsylbLG' ELSE 'X' END"
_LAWTEXT = "repeat('## § 1 Wort' || chr(10) || 'Satz.' || chr(10), CAST(5 + c_custkey % 9 AS INT)) || CASE WHEN c_custkey % 3 = 0 THEN '### § 2' || chr(10) || '# § 4 Ende' ELSE '# Art. 5' || chr(10) || '## § 40 a' END"


@query("plausible_laws", f"SELECT c_custkey, len(regexp_extract_all(t, '(?m)^#+\\s*(?:§|Art\\.?)\\s*\\S+')) >= 10 AND (c_custkey % 4 <> 0 OR c_custkey % 3 = 0) AS valid FROM (SELECT c_custkey, {_LAWTEXT} AS t FROM customer)")
def plausible_laws(spark, d):
    return table(spark, d, "customer").select("c_custkey", G.plausible_law(F.expr(_LAW), F.expr(_LAWTEXT)).alias("valid"))


_LETTER = """'Kanzlei Beispiel' || chr(10) || 'In dem Verfahren Nr. ' || c_custkey || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN 'des [PERSON], wohnhaft' ELSE '- Antragsteller -' END || chr(10) || 'gegen' || chr(10) || 'die Bundesrepublik Deutschland'
 || chr(10) || '[PERSON] [ADRESSE].' || chr(10) || 'Der Antrag ' || c_nationkey || ' ist gegen den Bescheid gerichtet, wie die Kanzlei Beispiel in ihrem Schreiben an das Gericht vom Mai schreibt.' || chr(10)
 || 'Unsere Bankverbindung: X' || chr(10) || 'IBAN DE12 3456 7890 1234 5678 90, BIC: ABCDEFGH, Steuernummer 12/' || c_nationkey || ' Finanzamt Mitte' || chr(10) || 'LG-Fach 12, Tel. +49 30 1234567, Az. 123a/' || (10 + c_custkey % 90) || ' K'"""
_OPEN = "chr(10) || 'Der Antrag ' || c_nationkey || ' ist gegen den Bescheid gerichtet, wie die Kanzlei Beispiel in ihrem Schreiben an das Gericht vom Mai schreibt.' || chr(10)"


@query("cleaned_letters", f"""SELECT c_custkey, '[PERSON] [ADRESSE].' || {_OPEN} || split_part({_LETTER}, 'schreibt.' || chr(10), 2) AS raw,
'Kanzlei Beispiel' || {_OPEN} || split_part({_LETTER}, 'schreibt.' || chr(10), 2) AS redacted,
'Kanzlei Beispiel' || {_OPEN} || '[BANKVERBINDUNG]' || chr(10) || '[IBAN], [BIC], [STEUERNUMMER]' || chr(10) || '[LG-FACH], Tel. [TEL], Az. [AKTENZEICHEN]' AS scrubbed FROM customer""")
def cleaned_letters(spark, d):
    """Letterhead and caption out of the raw letter, caption and marker lines out of the redacted one, and what redaction left."""
    t = F.expr(_LETTER)
    clean = Z.clean_redacted(t)
    return table(spark, d, "customer").select("c_custkey", Z.without_letterhead(t, (), r"(?i)kanzlei\s+beispiel").alias("raw"), clean.alias("redacted"), Z.scrub_residue(clean).alias("scrubbed"))


_AZ = """CASE o_orderkey % 4 WHEN 0 THEN 'VG 12 K ' || o_custkey || '.20 A' WHEN 1 THEN 'BVerwG,  1 C ' || o_custkey || '.19 - Muster' WHEN 2 THEN 'C-' || o_custkey || '/17 [Jawo] (Wx)' ELSE '4 LB ' || o_custkey || '/20 OVG' END"""


@query("number_dialects", r"""SELECT o_orderkey, lower(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS spaced, lower(regexp_replace(t, '\s+', '', 'g')) AS tight,
CASE o_orderkey % 4 WHEN 0 THEN '12k' || o_custkey || '.20a' WHEN 1 THEN ',1c' || o_custkey || '.19' WHEN 2 THEN 'c-' || o_custkey || '/17' ELSE '4lb' || o_custkey || '/20' END AS compared FROM (SELECT o_orderkey, o_custkey, """ + _AZ + " AS t FROM orders)")
def number_dialects(spark, d):
    t = F.expr(_AZ)
    return table(spark, d, "orders").select("o_orderkey", I.number_spaced(t).alias("spaced"), I.number_tight(t).alias("tight"), I.number_compared(t).alias("compared"))


_FILE = "'akten/Doc.' || (l_partkey % 9) || CASE WHEN l_linenumber <= 2 THEN '.odt' ELSE '.PDF' END"


@query("files_not_in_case", "SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_linenumber > 2 AND NOT EXISTS (FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber <= 2 AND b.l_partkey % 9 = a.l_partkey % 9)")
def files_not_in_case(spark, d):
    f = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_FILE).alias("path"))
    return V.not_in_case(f.where("l_linenumber > 2"), f.where("l_linenumber <= 2"), "l_orderkey", "path").select("l_orderkey", "l_linenumber")


_ITEM = """o_orderkey AS k, CAST(i AS INT) AS item, 'D' || i AS source_key, CASE i WHEN 1 THEN 'Ladung' WHEN 2 THEN 'Hauptakte' ELSE 'Bericht 3' END AS label,
CASE (o_orderkey + i) % 4 WHEN 0 THEN 'bescheid' WHEN 1 THEN 'akte' WHEN 2 THEN 'vorinstanz' ELSE 'sonstiges' END AS category, CASE WHEN i = 1 THEN 'primary' ELSE 'other' END AS role,
CAST(i * 10 AS INT) AS page_start, CAST(i * 10 + CASE WHEN o_orderkey % 2 = 0 THEN 12 ELSE 8 END AS INT) AS page_end"""
_CITED = """l_orderkey AS k, CAST(l_linenumber AS INT) AS n, CASE WHEN l_linenumber = 1 THEN 'D2' END AS source_key, CASE WHEN l_linenumber = 2 THEN 'Anlage K 2' WHEN l_linenumber = 3 THEN 'Bl. ' || (10 + l_partkey % 30) ELSE '' END AS citation,
CASE l_linenumber WHEN 4 THEN 'siehe Hauptakte, Mitte' WHEN 5 THEN 'im Urteil steht' ELSE '' END AS hint, CASE WHEN l_linenumber = 3 THEN CAST(10 + l_partkey % 30 AS INT) END AS page"""


@query("resolved_citations", f"""WITH i AS (SELECT {_ITEM} FROM orders, unnest([1, 2, 3]) AS t(i) WHERE i <= 1 + o_orderkey % 3), c AS (SELECT {_CITED} FROM lineitem), p AS (SELECT c.k, c.n, item, c.source_key = i.source_key AS r1,
n = 2 AND category = 'bescheid' AND role = 'primary' AS r2, n = 3 AND page BETWEEN page_start AND page_end AS r3, n = 3 AND category = 'akte' AS r4, n = 3 AND page = page_end AS r5,
n = 4 AND label = 'Hauptakte' AS r6, n = 5 AND category = 'vorinstanz' AS r7, item IS NOT NULL AS r8 FROM c LEFT JOIN i USING (k)),
a AS (SELECT k, n, {', '.join(f'count(*) FILTER (WHERE r{j}) AS n{j}, min(item) FILTER (WHERE r{j}) AS i{j}' for j in range(1, 9))} FROM p GROUP BY k, n)
SELECT k, n, CASE WHEN n1 > 0 THEN i1 WHEN n2 > 0 THEN i2 {' '.join(f'WHEN n{j} = 1 THEN i{j}' for j in range(3, 9))} END AS item,
CASE WHEN n1 > 0 THEN 'key' WHEN n2 > 0 THEN 'exhibit' WHEN n3 = 1 THEN 'sheet' WHEN n4 = 1 THEN 'file' WHEN n5 = 1 THEN 'pages' WHEN n6 = 1 THEN 'label' WHEN n7 = 1 THEN 'category' WHEN n8 = 1 THEN 'only' END AS rule FROM a""")
def resolved_citations(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("i")).where("i <= 1 + o_orderkey % 3")
    items = o.selectExpr(*_split(_ITEM)).withColumn("pages", F.array("page_end"))
    cited = table(spark, d, "lineitem").selectExpr(*_split(_CITED)).withColumn("pages", F.when(F.col("page").isNotNull(), F.array("page")))
    return V.resolve(cited, items, "k", ["n"])


def _split(columns: str) -> list[str]:
    """The columns of a select list: cut at commas outside brackets and quotes."""
    out, depth, quoted, last = [], 0, False, 0
    for i, c in enumerate(columns):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(columns[last:i])
            last = i + 1
    return [*out, columns[last:]]


@query("matched_runs", """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events QUALIFY n <= 40)
SELECT user_id, event_id FROM r WHERE (user_id % 3 = 0 OR event_type = 'click') AND (user_id % 5 = 0 OR event_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n) <= 5""")
def matched_runs(spark, d):
    e, u = table(spark, d, "events"), F.col("user_id")
    runs = e.select("user_id", "event_id", F.concat_ws(" ", F.lit("Zu"), "event_type", F.when(F.col("event_id") % 2 == 0, "AsylG § 3")).alias("text"))
    wanted = e.select("user_id").distinct().select("user_id", F.when(u % 3 != 0, F.array(F.lit("CLICK"))).alias("countries"), F.when(u % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("asylg  § 3"))).alias("tags"))
    return V.matching_runs(runs, wanted, "user_id", F.col("event_id").desc(), "text").select("user_id", "event_id")


_ANSWER = "'Siehe [Titel ' || page_id || '](http://a.example/' || page_id || '). Ferner das Gericht http://b.example/' || (page_id % 50) || ' und nochmals http://a.example/' || page_id || '. Bei http://c.example/x'"


@query("linked_titles", """SELECT page_id, n, 'http://' || CASE n WHEN 0 THEN 'a.example/' || page_id WHEN 1 THEN 'b.example/' || (page_id % 50) WHEN 2 THEN 'a.example/' || page_id || '.' ELSE 'c.example/x' END AS url,
CASE n WHEN 0 THEN 'Titel ' || page_id WHEN 1 THEN 'Ferner das Gericht' WHEN 2 THEN 'example/' || (page_id % 50) || ' und nochmals' ELSE 'http://c.example/x' END AS title FROM pages, unnest([0, 1, 2, 3]) AS t(n)""")
def linked_titles(spark, d):
    return V.links_with_titles(table(spark, d, "pages").select("page_id", F.expr(_ANSWER).alias("said")), "page_id", "said")


_HEAD = "CASE p_partkey % 6 WHEN 0 THEN 'Anhörung vom Mai' WHEN 1 THEN 'Der Bescheid' WHEN 2 THEN 'Bescheid des Amts' WHEN 3 THEN 'Widerspruchsbescheid' WHEN 4 THEN 'Ladung' END"


@query("wanted_titles", "SELECT p_partkey FROM part WHERE p_partkey % 6 <= 1")
def wanted_titles(spark, d):
    return table(spark, d, "part").where(V.title_wanted(F.expr(_HEAD), ["Anhorung", "bescheid", ""])).select("p_partkey")


@query("picked_laws", "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'eli/a/2020-01-0' || (1 + c_custkey % 9) || '/x' WHEN c_nationkey % 3 = 1 THEN 'eli/b' END AS identifier, CASE WHEN c_nationkey % 3 = 0 THEN '2020-01-0' || (1 + c_custkey % 9) ELSE '' END AS day FROM customer")
def picked_laws(spark, d):
    """The first of three search hits with the very abbreviation and an identifier."""
    hit = lambda a, i: F.struct(a.alias("abbreviation"), i.alias("identifier"))
    n, dated = F.col("c_nationkey") % 3, F.concat(F.lit("eli/a/2020-01-0"), (1 + F.col("c_custkey") % 9).cast("string"), F.lit("/x"))
    members = F.array(hit(F.lit("AsylbLG"), F.lit("eli/c")), hit(F.lit("AsylG"), F.lit("")), hit(F.when(n == 0, "AsylG"), dated), hit(F.when(n <= 1, "AsylG").otherwise("asylg"), F.lit("eli/b")))
    found = V.pick_law(members, F.lit("AsylG"))["identifier"]
    return table(spark, d, "customer").select("c_custkey", found.alias("identifier"), V.version_date(found).alias("day"))


_OP = "user_id, event_id, CASE event_id % 5 WHEN 0 THEN 'set' WHEN 1 THEN 'remove' ELSE 'append' END AS op, event_type AS field, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'Wert  ' || (event_id % 30) END AS value"
_HAVE = "SELECT user_id, 'click' AS field, 'wert ' || (user_id % 30) AS value FROM events GROUP BY user_id UNION ALL SELECT user_id, 'error', 'WERT 7' FROM events GROUP BY user_id"


@query("new_operations", f"""WITH o AS (SELECT *, lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS v FROM (SELECT {_OP} FROM events)), c AS (SELECT user_id, field, lower(value) AS v FROM ({_HAVE})), f AS (SELECT * FROM o WHERE op = 'remove'
OR ((user_id, field, v) NOT IN (SELECT (user_id, field, v) FROM c) AND v <> '' OR op = 'set' AND v = '' AND field = 'click') AND NOT (op = 'set' AND field = 'click')),
g AS (SELECT * FROM f QUALIFY op = 'remove' OR row_number() OVER (PARTITION BY user_id, field, v, op = 'remove' ORDER BY event_id) = 1), h AS (SELECT * FROM g QUALIFY op <> 'append' OR row_number() OVER (PARTITION BY user_id, field, op = 'append' ORDER BY event_id) <= 3)
SELECT user_id, event_id FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 8""")
def new_operations(spark, d):
    """Operations against what the document says ("click") and what is pending ("error"); curated fields are protected."""
    e = table(spark, d, "events")
    u = e.select("user_id").distinct()
    current = u.select("user_id", F.lit("click").alias("field"), F.concat(F.lit("wert "), (F.col("user_id") % 30).cast("string")).alias("value"))
    pending = u.select("user_id", F.lit("error").alias("field"), F.lit("WERT 7").alias("value"))
    return M.new_ops(e.selectExpr(*_split(_OP)), current, pending, "user_id", "event_id", protect=True).select("user_id", "event_id")


_ENGINES = {
    "first": K.Scorer(once=((("example.org", "example.net"), 70), (("ing", "der"), 140), (("/de/",), -260)), unless=((("ing", "der"), -100),), pdf=6, since=2014, per_year=3),
    "second": K.Scorer(once=((("ad",), -60),), each=((("the", "la", "er"), 12),), since=0, per_year=3),
    "third": K.Scorer(once=((("tion",), -50),), each=((("the", "la"), 15),), pdf=6),
}
_SHOT = "lower(url || ' ' || coalesce(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') || ' im Jahr ' || (2000 + page_id % 40))"


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


# the year of a decision: the latest of full dates, else the latest bare one up to next year, else the latest bare one
_DATED = r"list_max(list_transform(regexp_extract_all(t, '((?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2})', 1), lambda x: regexp_extract(x, '((?:19|20)[0-9]{2})', 1)::INT))"
_BARE = r"list_transform(regexp_extract_all(t, '(?:^|[^0-9A-Za-z_])((?:19|20)[0-9]{2})\b', 1), lambda x: x::INT)"


@query("engine_scores", f"""SELECT page_id, 6 * pdf + 70 * {_has('example.org', 'example.net')}::INT + CASE WHEN {_has('ing', 'der')} THEN 140 ELSE -100 END - 260 * {_has('/de/')}::INT + 3 * greatest(0, y - 2014) AS first,
-60 * {_has('ad')}::INT + 12 * ({_has('the')}::INT + {_has('la')}::INT + {_has('er')}::INT) + 3 * y AS second, 6 * pdf - 50 * {_has('tion')}::INT + 15 * ({_has('the')}::INT + {_has('la')}::INT) AS third
FROM (SELECT *, coalesce({_DATED}, list_max(list_filter({_BARE}, lambda x: x <= 2027)), list_max({_BARE}), 0) AS y FROM (SELECT page_id, coalesce({_SHOT}, '') AS t, coalesce(contains(lower(url), '.pdf'), false)::INT AS pdf FROM pages))""")
def engine_scores(spark, d):
    t = F.expr(_SHOT)
    return table(spark, d, "pages").select("page_id", *(K.engine_score(F.col("url"), t, s, 2026).alias(n) for n, s in _ENGINES.items()))


@query("merged_engines", f"""WITH a AS (SELECT page_id, url, 0 AS engine FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, upper(substr(url, 1, 4)) || substr(url, 5) || '#x', 1 FROM pages WHERE page_id % 2 = 0)
SELECT arg_min(page_id, (engine, page_id, url)) AS page_id, min(engine) AS engine, count(DISTINCT engine) AS engines FROM (SELECT page_id, engine, url, {_CANON} AS u FROM a) GROUP BY u""")
def merged_engines(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    other = p.where("page_id % 2 = 0").withColumn("url", F.concat(F.upper(F.substring("url", 1, 4)), F.expr("substring(url, 5)"), F.lit("#x")))
    return K.merge_engines([p.where("page_id % 3 = 0"), other], "url", "page_id").select("page_id", "engine", "engines")


def _report(spark, d):
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 1500, "SHORT"), F.when(F.col("lang") != "de", "LANG"), F.when(F.col("doc_id") % 2 == 0, "EVEN")))
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("extension"), F.when(F.size(reasons) > 1, "EXCLUDE").otherwise("INCLUDE").alias("decision"), reasons.alias("reasons"), F.when(F.col("doc_id") % 3 == 0, 0.5).alias("confidence"))


_WHY = "list_filter([CASE WHEN n_chars < 1500 THEN 'SHORT' END, CASE WHEN lang <> 'de' THEN 'LANG' END, CASE WHEN doc_id % 2 = 0 THEN 'EVEN' END], lambda x: x IS NOT NULL)"
_ROWS = f"(SELECT doc_id, source AS extension, CASE WHEN len(r) > 1 THEN 'EXCLUDE' ELSE 'INCLUDE' END AS decision, r, doc_id % 3 = 0 AS c FROM (SELECT *, {_WHY} AS r FROM documents))"


@query("report_rows", f"SELECT doc_id::VARCHAR AS doc_id, coalesce(extension, '') AS extension, decision, array_to_string(r, ';') AS reasons, CASE WHEN c THEN '0.5' ELSE '' END AS confidence FROM {_ROWS}")
def report_rows(spark, d):
    return S.flat_row(_report(spark, d))


@query("report_summary", f"""SELECT 'total' AS part, NULL AS name, NULL AS decision, count(*) AS n FROM {_ROWS} UNION ALL SELECT 'decision', NULL, decision, count(*) FROM {_ROWS} GROUP BY decision
UNION ALL SELECT 'extension', extension, decision, count(*) FROM {_ROWS} GROUP BY ALL UNION ALL SELECT 'reason', x, NULL, count(*) FROM (SELECT unnest(r) AS x FROM {_ROWS}) GROUP BY x""")
def report_summary(spark, d):
    return S.summary(_report(spark, d), "decision", "extension", "reasons")


_COURT = "CASE c_custkey % 5 WHEN 0 THEN 'BVerwG' WHEN 1 THEN 'OVG Münster' WHEN 2 THEN 'VG Köln' WHEN 3 THEN 'Amt' END"


@query("decision_entries", f"""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Unbekannt' ELSE 'Syrien' END AS country, CASE WHEN c_custkey % 2 = 0 THEN 'flucht,' ELSE '' END || CASE WHEN c_custkey % 4 = 0 THEN 'unbekannt' ELSE 'syrien' END || ',' || lower(c_mktsegment) AS tags,
CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE 'granted' END AS outcome, CASE c_custkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS weight FROM customer""")
def decision_entries(spark, d):
    k = F.col("c_custkey")
    found = table(spark, d, "customer").select(
        "c_custkey", F.when(k % 4 != 0, " Syrien ").otherwise(" ").alias("country"), F.when(k % 2 == 0, F.array(F.lit("flucht"))).alias("tags"), F.array("c_mktsegment", F.lower("c_mktsegment")).alias("keywords"),
        F.lit(None).cast("string").alias("court_level"), F.expr(_COURT).alias("court"), F.when(k % 3 != 0, "granted").otherwise("").alias("outcome"),
    )
    e = S.decision_entries(found, {"bverwg": 3, "ovg": 2, "vg": 1})
    return e.select("c_custkey", "country", F.array_join("tags", ",").alias("tags"), "outcome", F.col("instance_weight").alias("weight"))


_SIGNED = """CASE c_custkey % 6 WHEN 0 THEN 'Text. Im Auftrag Max Muster' || chr(10) || 'Ende' WHEN 1 THEN 'Unterschrift des Amts:' || chr(10) || 'Brozio' WHEN 2 THEN 'Hr. Naeem Adam, der Gründer von X; gez. MAX MUSTER' WHEN 3 THEN 'Name des Klägers: Ali  Omar (neu), geb. 1.1.1990' || chr(10) || 'Vorname: Ali Omar'
WHEN 4 THEN 'Name: Amt für Fragen' || chr(10) || 'im Auftrag der Stadt' END"""


@query("marked_names", f"SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Max Muster' WHEN 1 THEN 'Brozio' WHEN 2 THEN 'MAX MUSTER,Naeem Adam' WHEN 3 THEN CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE 'Ali Omar' END ELSE '' END AS names FROM (SELECT c_custkey, c_nationkey, {_SIGNED} AS t FROM customer)")
def marked_names(spark, d):
    """Names beside signatures, functions and fields that are not known yet."""
    known = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit(" ali omar")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(A.marked_names(F.expr(_SIGNED), known), ",").alias("names"))
