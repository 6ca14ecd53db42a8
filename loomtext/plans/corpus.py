"""Corpus decisions, profiles and purge rules; page URLs play file paths."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import codes
from ..sources.tables import table
from .registry import query

#: Pattern tables of the decision cascade, by reason code.
HARD = {"HARD_BLOG": "^https?://blog[.]", "HARD_ANCHOR": "#top$"}
EXTERNAL = {"EXTERNAL_PAGE": "page=", "EXTERNAL_FEED": "utm_source=feed"}
TARGET = {"TARGET_HTML": "[.]html$", "TARGET_NUMBER": "/[0-9]+$"}
_SQL_CODES = lambda t: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(u, '{p}') THEN '{n}' END" for n, p in t.items()) + "], lambda x: x IS NOT NULL)"

_DECIDE = f"""WITH p AS (SELECT page_id, lower(url) AS u, length(html) AS chars FROM pages), s AS (SELECT *, {_SQL_CODES(HARD)} AS h, {_SQL_CODES(EXTERNAL)} AS x, {_SQL_CODES(TARGET)} AS t, regexp_matches(u, '/(en|de)/') AS inside,
 CASE WHEN contains(u, 'example.org') THEN 0.98 WHEN contains(u, 'example.net') AND contains(u, 'www.') THEN 0.85 WHEN contains(u, 'example.net') THEN 0.55 ELSE 0 END AS conf FROM p),
r AS (SELECT *, 30 + 25 * (len(t) > 0)::INT - 15 * (len(x) > 0)::INT + CASE WHEN conf >= 0.7 THEN 50 WHEN conf >= 0.4 THEN 20 ELSE 0 END AS sc FROM s),
o AS (SELECT *, CASE WHEN len(h) > 0 OR NOT inside THEN 'EXCLUDE' WHEN chars < 1000 AND conf < 0.7 THEN 'REVIEW' WHEN conf >= 0.7 AND sc >= 70 THEN 'INCLUDE' ELSE 'EXCLUDE' END AS decision FROM r)
SELECT page_id, decision, CASE WHEN len(h) > 0 THEN 0 WHEN NOT inside THEN 0 ELSE sc END AS score,
 array_to_string(CASE WHEN len(h) > 0 THEN h WHEN NOT inside THEN ['OUTSIDE_CASE_FOLDER'] ELSE list_concat(['IN_CASE_FOLDER'], list_concat(CASE WHEN len(t) > 0 THEN t ELSE ['TARGET_MISSING_SIGNAL'] END, x)) END, ';') AS reasons FROM o"""


def decided(spark, d):
    """One decision per file: hard excludes, then the folder, then signals, letterhead confidence and thresholds."""
    u = F.lower("url")
    p = table(spark, d, "pages").select("page_id", u.alias("u"), F.length("html").alias("chars"))
    c = F.col
    conf = F.when(c("u").contains("example.org"), 0.98).when(c("u").contains("example.net") & c("u").contains("www."), 0.85).when(c("u").contains("example.net"), 0.55).otherwise(0.0)
    s = p.select("*", codes(c("u"), HARD).alias("h"), codes(c("u"), EXTERNAL).alias("x"), codes(c("u"), TARGET).alias("t"), c("u").rlike("/(en|de)/").alias("inside"), conf.alias("conf"))
    letter = F.when(c("conf") >= 0.7, 50).when(c("conf") >= 0.4, 20).otherwise(0)
    s = s.withColumn("sc", 30 + F.when(F.size("t") > 0, 25).otherwise(0) - F.when(F.size("x") > 0, 15).otherwise(0) + letter)
    out = (F.size("h") > 0) | ~c("inside")
    decision = F.when(out, "EXCLUDE").when((c("chars") < 1000) & (c("conf") < 0.7), "REVIEW").when((c("conf") >= 0.7) & (c("sc") >= 70), "INCLUDE").otherwise("EXCLUDE")
    target = F.when(F.size("t") > 0, c("t")).otherwise(F.array(F.lit("TARGET_MISSING_SIGNAL")))
    reasons = F.when(F.size("h") > 0, c("h")).when(~c("inside"), F.array(F.lit("OUTSIDE_CASE_FOLDER"))).otherwise(F.concat(F.array(F.lit("IN_CASE_FOLDER")), target, c("x")))
    return s.select("page_id", decision.alias("decision"), F.when(out, 0).otherwise(c("sc")).alias("score"), F.array_join(reasons, ";").alias("reasons"))


query("file_decisions", _DECIDE)(decided)


@query("decision_counts", f"WITH f AS ({_DECIDE}) SELECT decision, count(*) AS n, min(score)::BIGINT AS lowest FROM f GROUP BY 1")
def decision_counts(spark, d):
    return decided(spark, d).groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("long").alias("lowest"))


@query("top_reasons", f"WITH f AS ({_DECIDE}) SELECT reason, count(*) AS n FROM f, unnest(string_split(reasons, ';')) AS t(reason) GROUP BY 1 ORDER BY n DESC, reason LIMIT 30")
def top_reasons(spark, d):
    r = decided(spark, d).select(F.explode(F.split("reasons", ";")).alias("reason"))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "reason").limit(30)


@query("corpus_profile", "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(*) FILTER (WHERE n_chars < 1500) AS short, max(n_chars) AS longest FROM documents GROUP BY lang, source")
def profile(spark, d):
    g = table(spark, d, "documents").groupBy("lang", "source")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.count(F.when(F.col("n_chars") < 1500, 1)).alias("short"), F.max("n_chars").alias("longest"))


@query("language_by_label", "SELECT lang, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad, count(*) FILTER (WHERE quality IS NULL) AS unknown FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def by_label(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    q = F.col("quality")
    return j.groupBy("lang").agg(F.count(F.when(q == 1, 1)).alias("good"), F.count(F.when(q == 0, 1)).alias("bad"), F.count(F.when(q.isNull(), 1)).alias("unknown"))


@query("purge_decisions", """WITH t AS (SELECT doc_id, n_chars, list_filter([CASE WHEN contains(text, 'icense') THEN 'license' END, CASE WHEN contains(text, '!!') THEN 'noise' END, CASE WHEN contains(text, '@') THEN 'contact' END], lambda x: x IS NOT NULL) AS tags FROM documents),
b AS (SELECT *, len(tags) > 0 AND NOT list_contains(tags, 'contact') AS boiler FROM t) SELECT doc_id, CASE WHEN n_chars < 1500 AND boiler THEN 'PURGE' WHEN n_chars < 1500 THEN 'REVIEW' WHEN n_chars < 3000 AND boiler THEN 'REVIEW' ELSE 'KEEP' END AS bucket FROM b""")
def purge(spark, d):
    """PURGE, REVIEW or KEEP by length and by tags that are all boilerplate."""
    tags = codes(F.col("text"), {"license": "icense", "noise": "!!", "contact": "@"})
    t = table(spark, d, "documents").select("doc_id", "n_chars", tags.alias("tags"))
    boiler = (F.size("tags") > 0) & (F.size(F.array_except("tags", F.array(F.lit("license"), F.lit("noise")))) == 0)
    n = F.col("n_chars")
    return t.select("doc_id", F.when((n < 1500) & boiler, "PURGE").when(n < 1500, "REVIEW").when((n < 3000) & boiler, "REVIEW").otherwise("KEEP").alias("bucket"))


_CATEGORY = "SELECT doc_id, n_chars, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'other' END AS category FROM documents"


@query("grouped_documents", f"""WITH c AS ({_CATEGORY}), g AS (SELECT category, count(*) AS n, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first_id, max(doc_id) AS last_id, sum(doc_id)::BIGINT AS id_sum FROM c GROUP BY 1)
SELECT doc_id, category, n, chars, first_id, last_id, id_sum FROM c JOIN g USING (category)""")
def grouped(spark, d):
    """Every document with its category, which may be the rest, and how many and how long that category's are; a row a document, so that no list grows with a category."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.when(F.col("lang").isin("en", "de"), F.col("lang")).otherwise("other").alias("category"))
    of = docs.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("doc_id").alias("id_sum"))
    return docs.join(F.broadcast(of), "category").select("doc_id", "category", "n", "chars", "first_id", "last_id", "id_sum")  # three rows


@query("cost_rollup", "SELECT coalesce(l_returnflag, 'total') AS provider, round(sum(l_extendedprice * (1 - l_discount)), 2) AS cost, count(*) AS calls FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def costs(spark, d):
    """Cost by provider and in total."""
    g = table(spark, d, "lineitem").rollup("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("cost"), F.count(F.lit(1)).alias("calls"))
    return g.select(F.coalesce("l_returnflag", F.lit("total")).alias("provider"), "cost", "calls")


@query("latency_stats", "SELECT event_type, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def latency(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("engine_totals", "SELECT source, sum(n_chars)::BIGINT AS chars, arg_max(doc_id, n_chars * 1000000 - doc_id) AS longest, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def engines(spark, d):
    g = table(spark, d, "documents").groupBy("source")
    return g.agg(F.sum("n_chars").alias("chars"), F.max_by("doc_id", F.struct("n_chars", (-F.col("doc_id")).alias("x"))).alias("longest"), F.count_distinct("lang").alias("langs"))


@query("filename_tokens", r"SELECT page_id, regexp_extract(u, '/([a-z]{2})/([0-9]+)', 1) AS court, regexp_extract(u, '/([a-z]{2})/([0-9]+)', 2) AS number, array_to_string(list_sort(list_distinct(string_split(regexp_extract(u, '\?([^#]*)', 1), '&'))), ';') AS signals FROM (SELECT page_id, lower(url) AS u FROM pages)")
def tokens(spark, d):
    u = F.lower("url")
    signals = F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"))), ";")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(u, "/([a-z]{2})/([0-9]+)", 1).alias("court"), F.regexp_extract(u, "/([a-z]{2})/([0-9]+)", 2).alias("number"), signals.alias("signals"))


@query("parsed_dates", "SELECT o_orderkey, coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%d.%m.%Y'))::DATE::VARCHAR AS day FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE 'no date' END AS t FROM orders)")
def dates(spark, d):
    k = F.col("o_orderkey") % 3
    t = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise("no date")
    o = table(spark, d, "orders").select("o_orderkey", t.alias("t"))
    return o.select("o_orderkey", F.coalesce(F.try_to_date("t", "yyyy-MM-dd"), F.try_to_date("t", "dd.MM.yyyy")).cast("string").alias("day"))


@query("normalized_tags", "SELECT p_partkey, array_to_string(list_distinct_ordered, ',') AS tags FROM (SELECT p_partkey, [lower(p_name), lower(p_type)] AS list_distinct_ordered FROM part)")
def tags(spark, d):
    each = F.transform(F.array("p_name", "p_type", F.upper("p_name")), lambda x: F.regexp_replace(F.lower(F.trim(x)), r"\s+", " "))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_distinct(F.filter(each, lambda x: x != "")), ",").alias("tags"))


@query("dispatch_evidence", "WITH f AS (SELECT o_orderkey, o_custkey, CAST(o_orderkey % 100 AS VARCHAR) AS stem, o_orderstatus = 'F' AS sent FROM orders) SELECT a.o_orderkey, min(b.o_orderkey) AS evidence FROM f a JOIN f b ON a.o_custkey = b.o_custkey AND b.sent AND contains(b.stem, a.stem) WHERE NOT a.sent GROUP BY 1")
def dispatch(spark, d):
    """For drafts, the first sent file of the case whose stem contains theirs."""
    f = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 100).cast("string").alias("stem"), (F.col("o_orderstatus") == "F").alias("sent"))
    b = f.where("sent").groupBy("o_custkey", F.col("stem").alias("s")).agg(F.min("o_orderkey").alias("e"))
    j = f.where("not sent").join(b, "o_custkey").where(F.col("s").contains(F.col("stem")))
    return j.groupBy("o_orderkey").agg(F.min("e").alias("evidence"))


@query("provider_quality", "WITH s AS (SELECT source, n_chars % 100 AS sc, row_number() OVER (PARTITION BY source ORDER BY n_chars % 100 DESC, doc_id) AS r FROM documents) SELECT source, avg(sc)::DOUBLE AS mean_top, count(*) AS n FROM s WHERE r <= 10 GROUP BY 1")
def providers(spark, d):
    w = Window.partitionBy("source").orderBy(F.col("sc").desc(), "doc_id")
    s = table(spark, d, "documents").select("source", "doc_id", (F.col("n_chars") % 100).alias("sc")).withColumn("r", F.row_number().over(w)).where("r <= 10")
    return s.groupBy("source").agg(F.avg("sc").alias("mean_top"), F.count(F.lit(1)).alias("n"))
