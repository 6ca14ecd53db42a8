"""Hashes, duplicates, merges, deletes, paging and change detection on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_sha, strip_control
from ..operators.verification import contained
from ..operators.merge import delete, first_by, snapshot_diff, top_by, unseen, untold, upsert
from ..sources.tables import export_page, in_scope, page_after, page_at, scoped, seeded_sample, table
from .registry import query

_HASH = r"sha256(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\x{00AD}', '', 'g'), '-[ \t]*\n[ \t]*', '', 'g'), '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+', ' ', 'g'), '^[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g')))"


#: Lines of licences and notices, which do not make texts different.
BOILER = "(?i)(licensed under|all rights reserved|license)"
_CLEAN = _HASH.replace("(text,", f"(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{BOILER}')), chr(10)),")


@query("exact_duplicates", f"WITH h AS (SELECT {_CLEAN} AS sha, doc_id, n_chars FROM documents) SELECT sha, min(doc_id) AS keeper, count(*) AS copies, (count(*) - 1) * min_by(n_chars, doc_id) AS redundant_chars FROM h GROUP BY sha HAVING count(*) > 1")
def exact_duplicates(spark, d):
    docs = table(spark, d, "documents").select("doc_id", content_sha(F.col("text"), BOILER).alias("sha"), "n_chars")
    g = docs.groupBy("sha").agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("copies"), F.min_by("n_chars", "doc_id").alias("n"))
    return g.where("copies > 1").select("sha", "keeper", "copies", ((F.col("copies") - 1) * F.col("n")).alias("redundant_chars"))


@query("content_hashes", f"SELECT doc_id, {_HASH} AS sha FROM documents")
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", content_sha(F.col("text")).alias("sha"))


@query("unknown_documents", f"WITH k AS (SELECT DISTINCT {_HASH} AS sha FROM documents WHERE doc_id % 3 = 0), n AS (SELECT doc_id, {_HASH} AS sha FROM documents WHERE doc_id % 3 <> 0) SELECT min(doc_id) AS doc_id, sha FROM n WHERE sha NOT IN (SELECT sha FROM k) GROUP BY sha")
def unknown_documents(spark, d):
    """New documents that are neither known nor repeated within the run; a third plays the store."""
    hashed = table(spark, d, "documents").select("doc_id", content_sha(F.col("text")).alias("sha"))
    new = unseen(hashed.where("doc_id % 3 <> 0"), hashed.where("doc_id % 3 = 0"), ["sha"])
    return new.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))


@query("benchmark_hits", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_hits(spark, d):
    """Benchmark passages inside documents."""
    return contained(table(spark, d, "documents"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage")), "doc_id", "text", "item_id", "passage")


@query("dedup_index", f"SELECT {_HASH} AS sha, source AS first_source, doc_id AS first_doc FROM documents WHERE length(text) >= 200 QUALIFY row_number() OVER (PARTITION BY sha ORDER BY doc_id) = 1")
def dedup_index(spark, d):
    docs = table(spark, d, "documents").where(F.length("text") >= 200).select(content_sha(F.col("text")).alias("sha"), "source", "doc_id")
    return docs.groupBy("sha").agg(F.min_by("source", "doc_id").alias("first_source"), F.min("doc_id").alias("first_doc"))


@query("upsert_orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'U' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 5 = 0")
def upsert_orders(spark, d):
    """Orders divisible by 5 arrive again, twice; of the two the last wins. Those divisible by 7 are new then."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    again = orders.where("o_orderkey % 5 = 0")
    incoming = again.withColumn("status", F.lit("X")).withColumn("at", F.lit(1)).unionByName(again.withColumn("status", F.lit("U")).withColumn("at", F.lit(2)))
    return upsert(orders.where("o_orderkey % 7 <> 0"), incoming, "o_orderkey", "at")


@query("delete_orders", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))")
def delete_orders(spark, d):
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("hit")).distinct()
    orders = table(spark, d, "orders").join(gone, "o_orderkey", "left")
    return delete(orders, (F.col("o_orderstatus") == "F") & F.col("hit")).select("o_orderkey")


@query("delete_chunk_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_orderkey % 2 = 0 AND l_linenumber BETWEEN 2 AND 4)")
def delete_chunk_range(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return delete(lines, (F.col("l_orderkey") % 2 == 0) & F.col("l_linenumber").between(2, 4))


@query("client_batches", "SELECT source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 16) AS BIGINT) AS batch, doc_id FROM documents")
def client_batches(spark, d):
    """Batches of 16 per source, as a client would send them."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").select("source", F.floor((number - 1) / 16).alias("batch"), "doc_id")


@query("scroll_page", "SELECT doc_id, source FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 64")
def scroll_page(spark, d):
    return page_after(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 100, 64)


@query("offset_page", "SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def offset_page(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return page_at(orders, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 100, 50).select("o_orderkey", F.col("o_orderdate").cast("string").alias("day"))


@query("seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('seed' || doc_id), doc_id LIMIT 100")
def sampled(spark, d):
    return seeded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 100, "seed")


@query("snapshot_diff", "WITH b AS (SELECT page_id, url AS v FROM pages WHERE page_id % 4 <> 0), a AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN upper(url) ELSE url END AS v FROM pages WHERE page_id % 3 <> 0) SELECT page_id, CASE WHEN b.v IS NULL THEN 'new' WHEN a.v IS NULL THEN 'gone' WHEN a.v = b.v THEN 'unchanged' ELSE 'updated' END AS state FROM b FULL JOIN a USING (page_id)")
def pages_diff(spark, d):
    """Two snapshots of the pages: some are gone, some new, some changed."""
    pages = table(spark, d, "pages").select("page_id", "url")
    after = pages.where("page_id % 3 <> 0").withColumn("url", F.when(F.col("page_id") % 5 == 0, F.upper("url")).otherwise(F.col("url")))
    return snapshot_diff(pages.where("page_id % 4 <> 0"), after, "page_id", "url")


@query("gone_pages", "SELECT page_id FROM pages WHERE page_id % 2 = 0 AND page_id NOT IN (SELECT page_id FROM pages WHERE page_id % 3 = 0)")
def gone_pages(spark, d):
    pages = table(spark, d, "pages").select("page_id")
    return unseen(pages.where("page_id % 2 = 0"), pages.where("page_id % 3 = 0"), ["page_id"])


@query("latest_order_per_customer", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_order(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return first_by(orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


@query("keys_with_conflicts", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def conflicts(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("resume_after_log", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume(spark, d):
    """Work that a done-log does not list; the labels play the log."""
    return unseen(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("format_siblings", "WITH f AS (SELECT l_orderkey AS stem, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN 'pdf' ELSE 'odt' END AS ext FROM lineitem) SELECT stem, n, ext FROM f WHERE ext = 'pdf' OR stem NOT IN (SELECT stem FROM f WHERE ext = 'pdf')")
def siblings(spark, d):
    """Editable files go where the same stem exists as a final one."""
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stem"), F.col("l_linenumber").alias("n"), F.when(F.col("l_linenumber") % 2 == 0, "pdf").otherwise("odt").alias("ext"))
    return files.where("ext = 'pdf'").unionByName(unseen(files.where("ext = 'odt'"), files.where("ext = 'pdf'"), ["stem"]))


@query("owner_scope", "SELECT event_id, user_id FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id FROM events) WHERE user_id IS NULL OR user_id = 7")
def owner_scope(spark, d):
    events = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user_id"))
    return scoped(events, 7, "user_id")


@query("latest_events_per_user", "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 10")
def fan_out(spark, d):
    """The bounded buffer of each subscriber: the ten most recent events, older ones dropped."""
    events = table(spark, d, "events").select("user_id", "event_id", "ts")
    return top_by(events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 10).select("user_id", "event_id", "rank")


@query("control_characters", "SELECT doc_id, length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS dropped FROM documents")
def control_characters(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", (F.length(c) - F.length(strip_control(c))).cast("long").alias("dropped"))


@query("export_page", "WITH p AS (SELECT doc_id, lang FROM documents WHERE doc_id > 20 ORDER BY doc_id LIMIT 100) SELECT doc_id, lang, (SELECT CASE WHEN count(*) = 100 THEN max(doc_id) END FROM p) AS next_cursor FROM p")
def exported(spark, d):
    """The hundred documents after a cursor, with the cursor of the next page."""
    return export_page(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 20, 100)


@query("firm_scope", "SELECT event_id FROM events WHERE event_id % 4 = 0 OR user_id = 7")
def firm(spark, d):
    """Events that all may see, and a user's own."""
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 4 == 0, "firm").when(F.col("event_id") % 4 == 1, "user").alias("scope"))
    return in_scope(e, 7, "scope", "user_id").select("event_id")


@query("untold_titles", "WITH told AS (SELECT DISTINCT l_orderkey AS c, lower(trim(p_name)) AS t FROM lineitem JOIN part ON p_partkey = l_partkey), n AS (SELECT l_orderkey, l_linenumber, ' ' || upper(p_name) AS title FROM lineitem JOIN part ON p_partkey = l_suppkey) SELECT l_orderkey, l_linenumber FROM n ANTI JOIN told ON c = l_orderkey AND t = lower(trim(title))")
def untold_titles(spark, d):
    """Titles proposed for an order that none of its parts has."""
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"))
    proposed = lines.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("p_partkey")).join(parts, "p_partkey").withColumn("title", F.concat(F.lit(" "), F.upper("title")))
    sources = lines.select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    return untold(proposed, parts, sources, "l_orderkey", "p_partkey", "title").select("l_orderkey", "l_linenumber")
