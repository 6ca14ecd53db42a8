"""Field extraction, printed page numbers, stale children and small gates on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fields as E
from ..operators import reshape as H
from ..operators.merge import unseen
from ..sources.tables import table
from .registry import query

STOP = ("onent", "that", "this", "with")


@query("case_numbers", "SELECT o_orderkey, '12K' || o_custkey || '/21' AS numbers FROM orders")
def case_numbers(spark, d):
    t = F.concat(F.lit("Aktenzeichen: 12 K "), F.col("o_custkey").cast("string"), F.lit("/21, Az. der Akte"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(E.case_numbers(t), ",").alias("numbers"))


@query("keywords", "WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zäöüß]{4,}') AS ws FROM documents), w AS (SELECT doc_id, ws[i] AS t, min(i) AS p FROM d, unnest(range(1, len(ws) + 1)) AS u(i) WHERE ws[i] NOT IN ('onent', 'that', 'this', 'with') GROUP BY ALL), r AS (SELECT doc_id, t, p FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p) <= 12) SELECT doc_id, coalesce(words, '') AS words FROM documents LEFT JOIN (SELECT doc_id, string_agg(t, ',' ORDER BY p) AS words FROM r GROUP BY doc_id) USING (doc_id)")
def keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(E.keywords(F.col("text"), STOP), ",").alias("words"))


@query("source_courts", "SELECT page_id, CASE WHEN contains(url, 'example.org') THEN 'OVG' WHEN contains(url, 'blog') OR contains(url, 'm.') THEN 'VG' END AS court FROM pages")
def courts(spark, d):
    return table(spark, d, "pages").select("page_id", E.first_match(F.col("url"), (("OVG", ("example.org",)), ("VG", ("blog", "m.")))).alias("court"))


@query("normalized_entries", "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), ''), url) AS title, CASE WHEN contains(url, '.html') THEN 'page' WHEN contains(url, '?') THEN 'query' ELSE 'unknown' END AS evidence FROM pages")
def entries(spark, d):
    title = F.trim(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    return table(spark, d, "pages").select("page_id", F.when(title != "", title).otherwise(F.col("url")).alias("title"), E.first_match(F.col("url"), (("page", (".html",)), ("query", ("?",))), "unknown").alias("evidence"))


@query("printed_pages", """WITH p AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_id % 4 = 0 THEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) + user_id % 5 - 3 WHEN event_id % 31 = 1 AND user_id % 7 = 0 THEN 1 END AS pr FROM events),
q AS (SELECT *, last_value(CASE WHEN pr IS NOT NULL THEN n END IGNORE NULLS) OVER b AS bn, last_value(pr IGNORE NULLS) OVER b AS bp, first_value(CASE WHEN pr IS NOT NULL THEN n END IGNORE NULLS) OVER a AS an, first_value(pr IGNORE NULLS) OVER a AS ap FROM p
 WINDOW b AS (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY k ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
g AS (SELECT k, count(*) >= 3 AND count(pr) >= 3 AND count(*) FILTER (WHERE pr <= bp) = 0 AND count(*) FILTER (WHERE pr - bp = n - bn) >= greatest(1, (count(pr) - 1) // 2) AS ok FROM q GROUP BY k),
f AS (SELECT q.*, ok, coalesce(pr, CASE WHEN an IS NULL OR n - bn <= an - n THEN bp + n - bn ELSE ap + n - an END) AS f FROM q JOIN g USING (k)),
r AS (SELECT *, row_number() OVER (PARTITION BY k, f ORDER BY pr IS NULL, n) AS i FROM f)
SELECT k, n, CASE WHEN NOT ok THEN n WHEN pr IS NOT NULL OR (i = 1 AND f > 0) THEN f END AS folio FROM r""")
def printed(spark, d):
    """Pages of each user's event list with printed numbers on some; those of every seventh user do not rise."""
    e = table(spark, d, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    pr = F.when(F.col("event_id") % 4 == 0, F.col("n") + F.col("user_id") % 5 - 3).when((F.col("event_id") % 31 == 1) & (F.col("user_id") % 7 == 0), F.lit(1).cast("long"))
    return E.printed_pages(e.select(F.col("user_id").alias("k"), "n", pr.alias("pr")), "k", "n", "pr").select("k", "n", "folio")


@query("scan_form", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([a-zäöüß])-\n([a-zäöüß])', '\1\2', 'g'), '[ \t]+([,.;:])', '\1', 'g'), '[ \t]{2,}', ' ', 'g'), '([0-9])[oO]([0-9])', '\10\2', 'g'), '([0-9])[lI]([0-9])', '\11\2', 'g')) AS form_md5 FROM documents")
def scan_form(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(E.scan_form(F.col("text"))).alias("form_md5"))


@query("stale_children", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AND l_linenumber > 3)")
def stale_children(spark, d):
    """Children of a parent in scope that are no longer wanted go; all others stay."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    scope = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    gone = lines.where("l_linenumber > 3").join(scope, "l_orderkey", "left_semi")
    return unseen(lines, gone, ["l_orderkey", "l_linenumber"])


@query("category_policies", "SELECT event_id, event_type IN ('click', 'error') AS redact, event_type IN ('view') OR value > 90 AS recognise FROM events")
def policies(spark, d):
    t = F.col("event_type")
    return table(spark, d, "events").select("event_id", t.isin("click", "error").alias("redact"), (t.isin("view") | (F.col("value") > 90)).alias("recognise"))


@query("law_text_gate", "SELECT doc_id, len(string_split(text, chr(10))) - 1 >= 5 AND contains(text, 'e') AND regexp_matches(text, '[.]') AS valid FROM documents")
def law_gate(spark, d):
    """Plausible law texts: enough line breaks and every anchor there."""
    anchors = F.forall(F.array(F.lit("e"), F.lit(".")), lambda a: F.col("text").contains(a))
    return table(spark, d, "documents").select("doc_id", ((F.regexp_count("text", F.lit("\n")) >= 5) & anchors).alias("valid"))


@query("classified", "SELECT doc_id, CASE WHEN contains(text, '!!') THEN 'noise' WHEN contains(text, ' | ') THEN 'table' ELSE 'prose' END AS category, round(least(1.0, greatest(0.0, n_chars / 5000.0::DOUBLE)), 6) AS confidence FROM documents")
def classified(spark, d):
    """Closed categories with a confidence between 0 and 1; the port's stand-in looks for marks."""
    c = E.first_match(F.col("text"), (("noise", ("!!",)), ("table", (" | ",))), "prose")
    return table(spark, d, "documents").select("doc_id", c.alias("category"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("n_chars") / 5000.0)), 6).alias("confidence"))


@query("semantic_fill", "WITH h AS (SELECT l_suppkey AS page, l_orderkey AS hit, l_linenumber AS idx, l_shipdate::DATE::VARCHAR AS meta FROM lineitem) SELECT page, min(hit) AS first_hit, string_agg(idx::VARCHAR, ',' ORDER BY idx, hit) AS chunks, arg_min(meta, hit * 10 + idx) AS meta FROM h GROUP BY page")
def semantic_fill(spark, d):
    """Chunk hits by page: the first hit places a page, its chunks come in their own order."""
    h = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("hit"), F.col("l_linenumber").alias("idx"), F.col("l_shipdate").cast("date").cast("string").alias("meta"))
    chunks = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "hit"))), lambda x: x["idx"].cast("string")), ",")
    return h.groupBy("page").agg(F.min("hit").alias("first_hit"), chunks.alias("chunks"), F.min_by("meta", F.col("hit") * 10 + F.col("idx")).alias("meta"))


@query("area_order", "SELECT doc_id, array_to_string(list_transform(list_sort(list_filter([struct_pack(p := instr(text, 'the'), a := 'en'), struct_pack(p := instr(text, 'que'), a := 'es'), struct_pack(p := instr(text, 'ein'), a := 'de')], lambda x: x.p > 0)), lambda x: x.a), ',') AS areas FROM documents")
def area_order(spark, d):
    """Areas in the order in which their keywords first occur."""
    at = F.array(*(F.struct(F.instr("text", w).alias("p"), F.lit(a).alias("a")) for w, a in (("the", "en"), ("que", "es"), ("ein", "de"))))
    areas = F.transform(F.array_sort(F.filter(at, lambda x: x["p"] > 0)), lambda x: x["a"])
    return table(spark, d, "documents").select("doc_id", F.array_join(areas, ",").alias("areas"))


@query("usage_totals", "SELECT conv_id, sum(coalesce(length(text), 0))::BIGINT AS chars, count(*) FILTER (WHERE role = 'user') AS asked, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def usage(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id")
    return g.agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"), F.count(F.when(F.col("role") == "user", 1)).alias("asked"), F.max("turn").alias("last_turn"))


@query("seen_increment", "SELECT event_id FROM events WHERE user_id % 2 = 0 AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 5 = 0)")
def seen(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    return unseen(e.where("user_id % 2 = 0"), e.where("event_id % 5 = 0"), ["event_id"]).select("event_id")


@query("reshaped_answers", """WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 11 = 0 THEN '{}' ELSE '{"land":"' || p || '"' || CASE WHEN k % 2 = 1 THEN ',"themen":["t' || CAST(k % 5 AS VARCHAR) || '"]' ELSE '' END
 || CASE WHEN k % 4 <> 0 OR k % 3 <> 0 THEN ',"profil":{' || concat_ws(',', CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '"alter":"' || CAST(k % 90 AS VARCHAR) || '"' ELSE '"alter":' || CAST(k % 90 AS VARCHAR) END, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN '"geschlecht":"w"' ELSE '"geschlecht":"m"' END) || '}' ELSE '' END || '}' END AS nested,
 CASE WHEN k % 11 <> 0 THEN CASE k % 5 WHEN 1 THEN 'traegt' WHEN 2 THEN 'erwaehnt' END END AS role, CASE WHEN k % 11 <> 0 AND k % 5 > 2 THEN 'alter' ELSE '' END AS unknown FROM o""")
def reshaped_answers(spark, d):
    """Flat answers, some with nulls, wrong types, unknown words or no JSON at all, reshaped; made of the orders."""
    k = F.col("o_orderkey")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    age = F.when(k % 4 == 0, "null").when(k % 4 == 1, text((k % 90).cast("string"))).otherwise((k % 90).cast("string"))
    topics = F.when(k % 2 == 0, "[]").otherwise(F.concat(F.lit('["t'), (k % 5).cast("string"), F.lit('"]')))
    role = F.when(k % 5 == 0, "null").when(k % 5 == 1, '"Traegt"').when(k % 5 == 2, '" erwaehnt"').when(k % 5 == 3, '"stark"').otherwise("3")
    gender = F.when(k % 3 == 0, "").when(k % 3 == 1, "w").otherwise("m")
    whole = F.concat(F.lit('{"alter": '), age, F.lit(', "geschlecht": '), text(gender), F.lit(', "land": '), text(F.col("o_orderpriority")), F.lit(', "themen": '), topics, F.lit(', "reliance_alter": '), role, F.lit("}"))
    answers = table(spark, d, "orders").select("o_orderkey", F.when(k % 11 == 0, "no json").otherwise(whole).alias("answer"))
    a = F.col("answer")
    plain = F.from_json(a, "map<string,variant>")
    kept = F.when(plain.isNull(), a).otherwise(F.to_json(F.map_filter(plain, lambda x, v: x != "reliance_alter")))
    return answers.select("o_orderkey", H.nested(kept).alias("nested"), F.try_element_at(H.roles(a), F.lit("alter")).alias("role"), F.array_join(H.unknown_roles(a), ",").alias("unknown"))
