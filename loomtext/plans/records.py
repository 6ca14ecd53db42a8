"""Decision records, gates, headers, inventories and small list operators on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters as G
from ..operators import identity as I
from ..operators import packing as K
from ..operators.merge import first_by, unseen
from ..sources.tables import table
from .registry import query


@query("filtered_orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderdate::DATE >= DATE '1996-01-01' AND o_orderdate::DATE <= DATE '1999-12-31' AND list_has_any([o_orderpriority, o_orderstatus], ['F', 'P'])")
def filtered_orders(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date")).withColumn("tags", F.array("o_orderpriority", "o_orderstatus"))
    f = G.metadata_filter({"o_orderstatus": "F"}, {"o_orderpriority": ["1-URGENT", "5-LOW"]}, {"day": "1996-01-01"}, {"day": "1999-12-31"}, {"tags": ["F", "P"]})
    return o.where(f).select("o_orderkey")


@query("missing_fields", "SELECT doc_id, array_to_string(list_filter([CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END, CASE WHEN trim(coalesce(source, '')) = '' THEN 'source' END], lambda x: x IS NOT NULL), ',') AS missing FROM documents LEFT JOIN labels USING (doc_id)")
def missing_fields(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.array_join(G.missing(["quality", "toxic", "source"]), ",").alias("missing"))


@query("complete_records", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 AND text <> ''")
def complete(spark, d):
    """Records that pass the writeback gate: every field there and verified."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return j.where((F.size(G.missing(["quality", "toxic", "text"])) == 0) & (F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")


@query("written_back", "WITH n AS (SELECT o_orderkey, sha256(lower(o_orderpriority) || '|' || o_orderdate::DATE::VARCHAR || '|' || (o_custkey % 50)::VARCHAR) AS sha FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0), k AS (SELECT sha256(lower(o_orderpriority) || '|' || o_orderdate::DATE::VARCHAR || '|' || (o_custkey % 50)::VARCHAR) AS sha FROM orders WHERE o_orderkey % 2 = 1) SELECT min(o_orderkey) AS o_orderkey, sha FROM n WHERE sha NOT IN (SELECT sha FROM k) GROUP BY sha")
def written_back(spark, d):
    """Verified decisions that the store does not know by identity, the first of each."""
    sha = I.decision_sha(F.col("o_orderpriority"), F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 50).cast("string"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", sha.alias("sha"))
    new = unseen(o.where("o_orderstatus = 'F' and o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["sha"])
    return first_by(new, ["sha"], [F.col("o_orderkey")]).select("o_orderkey", "sha")


@query("gate_failures", "SELECT doc_id, NOT (r <> '' AND r <> text AND len(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}')) > 0) AS failed FROM (SELECT doc_id, text, regexp_replace(text, '[0-9]{3}-[0-9]{4}', '[PHONE]', 'g') AS r FROM documents)")
def gate_failures(spark, d):
    r = F.regexp_replace("text", "[0-9]{3}-[0-9]{4}", "[PHONE]")
    found = F.regexp_extract_all("text", F.lit("([0-9]{3}-[0-9]{4})"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", (~G.changed_output(F.col("text"), r, found)).alias("failed"))


@query("needs_enrichment", "SELECT event_id FROM events WHERE value > 1 AND (event_id % 4 = 0 OR event_type IS DISTINCT FROM 'click')")
def enrichment(spark, d):
    e = table(spark, d, "events").withColumn("at", F.when(F.col("event_id") % 4 != 0, F.col("ts")))
    return e.where(G.needs_enrichment(F.col("value") > 1, F.col("at"), F.col("event_type"), "click")).select("event_id")


@query("area_gate", "SELECT p_partkey, p_partkey % 3 = 0 OR p_type = 'ECONOMY' AS covered FROM part")
def area(spark, d):
    areas = F.when(F.col("p_partkey") % 3 != 0, F.array("p_type"))
    return table(spark, d, "part").select("p_partkey", G.covers_area(areas, "ECONOMY").alias("covered"))


@query("name_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '12') OR contains(lower(c_mktsegment), 'build') ORDER BY c_custkey LIMIT 500")
def name_search(spark, d):
    hit = F.lower("c_name").contains("12") | F.lower("c_mktsegment").contains("build")
    return table(spark, d, "customer").where(hit).orderBy("c_custkey").limit(500).select("c_custkey")


@query("playbook_list", "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) = lower('1-Urgent') AND list_contains([o_orderstatus], 'F') ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 100")
def playbook(spark, d):
    o = table(spark, d, "orders").where((F.lower("o_orderpriority") == "1-urgent") & F.array_contains(F.array("o_orderstatus"), "F"))
    return o.orderBy(F.col("o_orderdate").desc_nulls_last(), "o_orderkey").limit(100).select("o_orderkey")


@query("readable_names", r"SELECT page_id, regexp_matches(u, '\.(html|pdf|odt)$') AS readable, regexp_matches(u, '\.(png|jpe?g|gif)$') AS image FROM (SELECT page_id, lower(regexp_replace(url, '[?#].*$', '')) AS u FROM pages)")
def names(spark, d):
    u = F.lower(F.regexp_replace("url", "[?#].*$", ""))
    return table(spark, d, "pages").select("page_id", u.rlike(r"\.(html|pdf|odt)$").alias("readable"), u.rlike(r"\.(png|jpe?g|gif)$").alias("image"))


@query("number_keys", r"SELECT o_orderkey, lower(regexp_replace(t, '[\s.]+', '', 'g')) AS key, array_to_string(string_split_regex(t, '\s+')[2:], ' ') AS core FROM (SELECT o_orderkey, 'VG ' || (o_orderkey % 30) || ' K ' || o_custkey || '.' || (o_orderkey % 90 + 10) AS t FROM orders)")
def number_keys(spark, d):
    t = F.concat(F.lit("VG "), (F.col("o_orderkey") % 30).cast("string"), F.lit(" K "), F.col("o_custkey").cast("string"), F.lit("."), (F.col("o_orderkey") % 90 + 10).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", I.number_key(t).alias("key"), I.number_core(t).alias("core"))


@query("case_hashes", "SELECT o_orderkey, substr(sha256(regexp_extract(p, '([0-9]{1,4}/[0-9]{2})', 1)), 1, 12) AS hash FROM (SELECT o_orderkey, 'akten/' || (o_orderkey % 500) || '/' || strftime(o_orderdate, '%y') || '/x' AS p FROM orders)")
def case_hashes(spark, d):
    p = F.concat(F.lit("akten/"), (F.col("o_orderkey") % 500).cast("string"), F.lit("/"), F.date_format("o_orderdate", "yy"), F.lit("/x"))
    return table(spark, d, "orders").select("o_orderkey", I.case_hash(p).alias("hash"))


@query("provisions", "SELECT l_orderkey, l_linenumber, '§' || l_linenumber || ' Abs. ' || (l_suppkey % 4) || ' AsylG,§60' AS refs FROM lineitem")
def provisions(spark, d):
    c = F.col
    t = F.concat(F.lit("nach § "), c("l_linenumber").cast("string"), F.lit(" Abs. "), (c("l_suppkey") % 4).cast("string"), F.lit(" AsylG und §60, § 60"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(I.provisions(t), ",").alias("refs"))


@query("plain_markdown", "SELECT p_partkey, 'T ' || p_name || chr(10) || '• ' || p_brand || ' link' AS plain FROM part")
def plain_markdown(spark, d):
    md = F.concat(F.lit("## T **"), "p_name", F.lit("**\n- `"), "p_brand", F.lit("` [link](http://x)"))
    return table(spark, d, "part").select("p_partkey", I.plain_text(md).alias("plain"))


@query("portal_listings", "SELECT o_orderkey, 'VG ' || (o_custkey % 9) AS court, o_orderpriority AS kind, strftime(o_orderdate, '%d.%m.%Y') AS day, (o_orderkey % 30) || ' K 7/24' AS number FROM orders")
def listings(spark, d):
    """Footers of a decision portal taken apart: court, kind, date, file number."""
    c = F.col
    footer = F.concat(F.lit("(VG "), (c("o_custkey") % 9).cast("string"), F.lit(", "), c("o_orderpriority"), F.lit(" vom "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" - "), (c("o_orderkey") % 30).cast("string"), F.lit(" K 7/24 -)"))
    shape = r"\(([^,]+), (.+) vom ([0-9.]+) - (.+) -\)"
    part = lambda k: F.regexp_extract(footer, shape, k)
    return table(spark, d, "orders").select("o_orderkey", part(1).alias("court"), part(2).alias("kind"), part(3).alias("day"), part(4).alias("number"))


@query("detail_urls", "SELECT page_id, CASE WHEN contains(lower(url), lower('EN/' || (page_id % 10))) THEN url ELSE 'https://portal.test/' || lower('EN/' || (page_id % 10)) END AS detail FROM pages")
def detail_urls(spark, d):
    ident = F.concat(F.lit("EN/"), (F.col("page_id") % 10).cast("string"))
    return table(spark, d, "pages").select("page_id", F.when(F.lower("url").contains(F.lower(ident)), F.col("url")).otherwise(F.concat(F.lit("https://portal.test/"), F.lower(ident))).alias("detail"))


@query("page_metadata", "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<li>'))::BIGINT AS items, array_to_string(list_transform(string_split(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '. '), lambda x: trim(x)), ';') AS sentences FROM pages")
def page_metadata(spark, d):
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("items"), F.array_join(F.transform(F.split(title, r"\. "), lambda x: F.trim(x)), ";").alias("sentences"))


@query("keyword_suggestions", "WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), s AS (SELECT w, 0 AS k FROM w WHERE starts_with(w, 'b') UNION ALL SELECT w, 1 FROM w WHERE contains(w, 'b') AND NOT starts_with(w, 'b') AND (SELECT count(*) FROM w WHERE starts_with(w, 'b')) < 5) SELECT w AS keyword, row_number() OVER (ORDER BY k, w) AS place FROM s ORDER BY place LIMIT 10")
def suggestions(spark, d):
    """Keywords with the prefix first; those that only contain it where fewer than five begin with it; ten at most."""
    w = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    s = w.where(F.col("w").contains("b")).withColumn("k", F.when(F.col("w").startswith("b"), 0).otherwise(1))
    few = s.withColumn("n", F.sum(1 - F.col("k")).over(Window.partitionBy())).where("k = 0 or n < 5")
    return few.select(F.col("w").alias("keyword"), F.row_number().over(Window.orderBy("k", "w")).alias("place")).where("place <= 10")


@query("case_inventory", "SELECT c.c_custkey, n AS n_orders, last AS latest, substr(c_name, 1, 200) AS preview FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1) o ON o_custkey = c.c_custkey")
def inventory(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderkey").alias("latest"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", "n_orders", "latest", F.substring("c_name", 1, 200).alias("preview"))


@query("context_headers", "SELECT c_custkey, array_to_string(list_filter([nullif(c_mktsegment, 'HOUSEHOLD'), c_name, CASE WHEN c_custkey % 2 = 0 THEN 'Tags: ' || c_nationkey END], lambda x: x IS NOT NULL), ' | ') AS header FROM customer")
def headers(spark, d):
    tags = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Tags: "), F.col("c_nationkey").cast("string")))
    return table(spark, d, "customer").select("c_custkey", F.concat_ws(" | ", F.expr("nullif(c_mktsegment, 'HOUSEHOLD')"), "c_name", tags).alias("header"))


@query("retagged_headers", "SELECT c_custkey, c_name || ' | Tags: ' || c_mktsegment AS header FROM customer")
def retagged(spark, d):
    """Old tag segments go, the new ones are added."""
    old = F.concat(F.col("c_name"), F.lit(" | Tags: old | Tags: older"))
    kept = F.array_join(F.filter(F.split(old, r" \| "), lambda s: ~s.startswith("Tags: ")), " | ")
    return table(spark, d, "customer").select("c_custkey", F.concat(kept, F.lit(" | Tags: "), "c_mktsegment").alias("header"))


@query("entry_prose", "SELECT o_orderkey, o_orderpriority || chr(10) || 'Status: ' || o_orderstatus AS prose FROM orders")
def prose(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws("\n", "o_orderpriority", F.lit(None).cast("string"), F.concat(F.lit("Status: "), "o_orderstatus")).alias("prose"))


@query("outline_types", "SELECT page_id, CASE WHEN contains(t, 'ing') THEN 'hearing' WHEN contains(t, 'der') THEN 'notice' ELSE 'other' END AS kind FROM (SELECT page_id, lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS t FROM pages)")
def outline(spark, d):
    t = F.lower(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    return table(spark, d, "pages").select("page_id", F.when(t.contains("ing"), "hearing").when(t.contains("der"), "notice").otherwise("other").alias("kind"))


@query("merged_lists", "SELECT p_partkey, array_to_string(CASE WHEN p_type = p_brand THEN [p_type] ELSE [p_type, p_brand] END, ',') AS merged FROM part")
def merged_lists(spark, d):
    """An additive merge keeps the first list's order and adds what is new."""
    both = F.array_distinct(F.concat(F.array("p_type"), F.array("p_brand", "p_type")))
    return table(spark, d, "part").select("p_partkey", F.array_join(both, ",").alias("merged"))


@query("round_stops", "WITH r AS (SELECT user_id, event_id % 6 AS round, count(*) AS new FROM events GROUP BY ALL) SELECT user_id, min(round) AS stopped FROM r WHERE round > 0 AND new < 12 GROUP BY 1")
def rounds(spark, d):
    """The first follow-up round that brought too little."""
    r = table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 6).alias("round")).agg(F.count(F.lit(1)).alias("new"))
    return r.where("round > 0 and new < 12").groupBy("user_id").agg(F.min("round").alias("stopped"))


@query("preferred_urls", "SELECT page_id % 50 AS g, page_id FROM pages QUALIFY row_number() OVER (PARTITION BY page_id % 50 ORDER BY contains(url, 'example.org') DESC, contains(url, '.html') DESC, page_id) = 1")
def preferred(spark, d):
    p = table(spark, d, "pages").select((F.col("page_id") % 50).alias("g"), "page_id", "url")
    return first_by(p, ["g"], [F.col("url").contains("example.org").desc(), F.col("url").contains(".html").desc(), F.col("page_id")]).select("g", "page_id")


@query("page_scores", "SELECT p_partkey, 3 * (p_brand = 'Brand#2')::INT + 2 * (contains(p_name, 'ring'))::INT + (p_type = 'ECONOMY')::INT AS score FROM part WHERE score >= 2 ORDER BY score DESC, p_partkey LIMIT 40")
def page_scores(spark, d):
    """Country 3, norm 2, theme 1; pages with at least 2, the best forty."""
    s = 3 * (F.col("p_brand") == "Brand#2").cast("int") + 2 * F.size(F.array_intersect(F.split("p_name", " "), F.array(F.lit("ring")))) + (F.col("p_type") == "ECONOMY").cast("int")
    return table(spark, d, "part").select("p_partkey", s.alias("score")).where("score >= 2").orderBy(F.col("score").desc(), "p_partkey").limit(40)


@query("line_profile", "SELECT doc_id, count(*) AS n_lines, max(length(line))::BIGINT AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def lines(spark, d):
    each = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max(F.length("line")).cast("long").alias("longest"))


@query("nearest_headings", "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents), h AS (SELECT *, last_value(CASE WHEN length(line) < 40 AND line <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM l) SELECT doc_id, i, heading FROM h WHERE length(line) > 400")
def headings(spark, d):
    """The nearest short line before every long one."""
    each = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("i", (F.col("p") + 1).cast("long"))
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    short = F.when((F.length("line") < 40) & (F.col("line") != ""), F.col("line"))
    return each.withColumn("heading", F.last(short, ignorenulls=True).over(w)).where(F.length("line") > 400).select("doc_id", "i", "heading")


@query("context_blocks")
def context_blocks(spark, d):
    """Documents of a source packed into its context budget."""
    return K.pack_blocks(table(spark, d, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text", 12_000).select("source", "used", F.length("block").alias("chars"))


@query("context_prefix", "SELECT source, doc_id FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents) WHERE run <= 12000")
def context_prefix(spark, d):
    return K.pack_prefix(table(spark, d, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text", 12_000).select("source", "doc_id")


@query("case_entities", "SELECT source, count(DISTINCT value) AS n, max(length(value))::BIGINT AS longest FROM (SELECT source, unnest(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}')) AS value FROM documents) GROUP BY source")
def case_entities(spark, d):
    """Entities of a case: the union over its documents."""
    e = table(spark, d, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("([0-9]{3}-[0-9]{4})"), F.lit(1))).alias("value"))
    return e.groupBy("source").agg(F.count_distinct("value").alias("n"), F.max(F.length("value")).cast("long").alias("longest"))


@query("wiki_sections")
def wiki_sections(spark, d):
    """Heading paths of pages turned to Markdown."""
    from ..operators.chunking import section_paths, split_rows
    from ..sources.documents import html_to_markdown

    return split_rows(table(spark, d, "pages"), "page_id", "html", lambda h: [p for p, _ in section_paths(html_to_markdown(h))])


@query("cited_pages", "SELECT conv_id, turn, 3 + turn % 5 + k AS page FROM conversations, unnest(range(0, 2)) AS t(k)")
def cited_pages(spark, d):
    """``S. n f.`` citations expanded by the table function that SQL users call."""
    from ..sql import register

    register(spark)
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("vgl. S. "), (3 + F.col("turn") % 5).cast("string"), F.lit(" f. der Akte, nicht § 5 Abs. 2 S. 1")).alias("said"))
    c.createOrReplaceTempView("_said")
    return spark.sql("SELECT conv_id, turn, CAST(page AS BIGINT) AS page FROM _said, LATERAL citations_of(said)")
