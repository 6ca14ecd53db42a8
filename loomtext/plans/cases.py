"""Queries on cited decisions, fingerprints, proposals, entities of cases and ranked sources; the test tables play the files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import fingerprint as P
from ..operators import memory as M
from ..operators import privacy as A
from ..operators import ranking as K
from ..operators.merge import first_wins, page_aliases
from ..sources.tables import table
from .registry import query
from .web import _CANON, _KEY, POLICY, _pages

_AZ = "(1 + c_custkey % 300) || ' A ' || (c_custkey * 7 % 5000 + 1) || '/20'"


def _drafts(spark, d):
    """A letter for each customer that cites a higher court twice and, in every third, the federal court."""
    k = F.col("c_custkey")
    az = F.concat((1 + k % 300).cast("string"), F.lit(" A "), (k * 7 % 5000 + 1).cast("string"), F.lit("/20"))
    day = F.concat((1 + k % 28).cast("string"), F.lit(".3.2021"))
    twice = F.concat(F.lit("Vgl. OVG Münster, Urteil vom "), day, F.lit(" – "), az, F.lit("; ebenso  ovg Münster. So OVG  Münster, Urteil  vom 4.4.2022 - "), F.upper(az))
    text = F.concat(twice, F.when(k % 3 == 0, F.concat(F.lit("; BVerwG, Beschluss vom 01.02.2020 — 1 C "), (k % 50).cast("string"), F.lit(".19"))).otherwise(""), F.lit(", juris Rn. 5."))
    return table(spark, d, "customer").select("c_custkey", text.alias("text"), az.alias("az"), day.alias("day"))


@query("cited_decisions", f"SELECT c_custkey, 'OVG Münster' AS court, 'Urteil' AS kind, (1 + c_custkey % 28) || '.3.2021' AS date, {_AZ} AS az FROM customer UNION ALL SELECT c_custkey, 'BVerwG', 'Beschluss', '01.02.2020', '1 C ' || (c_custkey % 50) || '.19' FROM customer WHERE c_custkey % 3 = 0")
def cited(spark, d):
    return D.cited_decisions(_drafts(spark, d), "c_custkey", "text").drop("n")


@query("grounded_citations", "SELECT c_custkey, c_custkey % 4 <> 1 AND c_custkey % 4 <> 3 AS held FROM customer")
def grounded(spark, d):
    """Citations of a model against the letter: right ones in two spellings, a wrong number, a wrong day."""
    k = F.col("c_custkey")
    two = F.concat(F.lpad((1 + k % 28).cast("string"), 2, "0"), F.lit(".03.2021"))
    az = F.when(k % 4 == 1, F.concat("az", F.lit("9"))).when(k % 4 == 2, F.regexp_replace(F.lower("az"), " ", "")).otherwise(F.col("az"))
    day = F.when(k % 4 == 3, F.lit("31.12.1999")).otherwise(two)
    return _drafts(spark, d).select("c_custkey", D.grounded(az, day, F.lit("OVG NRW"), F.col("text")).alias("held"))


_HINT = "CASE p_partkey % 4 WHEN 0 THEN '7 L 12/21' WHEN 1 THEN (1 + p_partkey % 90) || ' K ' || p_partkey || '/22' WHEN 2 THEN (1 + p_partkey % 90) || ' K ' || p_partkey || '/24' ELSE '' END"


def _hinted(spark, d):
    k = F.col("p_partkey")
    number = (1 + k % 90).cast("string")
    given = F.when(k % 4 == 0, " 7 L 12/21 ").otherwise("")
    text = F.when(k % 4 == 1, F.concat(F.lit("Urteil zu "), number, F.lit("  K\n"), k.cast("string"), F.lit("/22 vom Mai"))).otherwise("ohne Zeichen")
    url = F.when(k % 4 == 2, F.concat(F.lit("https://a.de/x/"), number, F.lit("%5FK_"), k.cast("string"), F.lit("_24.html"))).otherwise("https://a.de/100%")
    return table(spark, d, "part").select("p_partkey", "p_size", D.file_hint(given, text, url).alias("hint"))


# the rule itself on the same texts: a number of seven digits has no file number's shape
_FOUND = rf"""(SELECT p_partkey, coalesce(nullif(trim(given), ''), nullif(regexp_extract(regexp_replace(said, '\s+', ' ', 'g'), '{D.FILE_IN_TEXT}'), ''),
CASE WHEN path <> '' THEN parts[1] || ' ' || parts[2] || ' ' || parts[3] || '/' || parts[4] END, '') AS h FROM (SELECT *, string_split_regex(path, '[-_]') AS parts FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' 7 L 12/21 ' ELSE '' END AS given,
CASE p_partkey % 4 WHEN 1 THEN 'Urteil zu ' || (1 + p_partkey % 90) || '  K' || chr(10) || p_partkey || '/22 vom Mai' ELSE 'ohne Zeichen' END AS said,
regexp_extract(CASE p_partkey % 4 WHEN 2 THEN url_decode('https://a.de/x/' || (1 + p_partkey % 90) || '%5FK_' || p_partkey || '_24.html') ELSE 'https://a.de/100%' END, '{D.FILE_IN_URL}') AS path FROM part)))"""


@query("file_hints", f"SELECT p_partkey, h AS hint FROM {_FOUND}")
def hints(spark, d):
    return _hinted(spark, d).select("p_partkey", "hint")


@query("known_sources", f"SELECT p_partkey, h <> '' AND regexp_replace(lower(h), '[^a-z0-9]', '', 'g') IN (SELECT (1 + p_partkey % 90) || 'k' || p_partkey || '22' FROM part WHERE p_partkey % 5 = 0) AS known FROM {_FOUND}")
def known(spark, d):
    k = F.col("p_partkey")
    store = table(spark, d, "part").where("p_partkey % 5 = 0").select(F.concat((1 + k % 90).cast("string"), F.lit("-K-"), k.cast("string"), F.lit("/22")).alias("az"))
    return D.mark_known(_hinted(spark, d), store, "hint", "az").select("p_partkey", "known")


@query("verified_batch", f"SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS turn FROM (SELECT p_size, p_partkey, {_HINT} AS h FROM part) WHERE h <> '' QUALIFY turn <= 8")
def batch(spark, d):
    """The first eight sources with a file number of each group."""
    return D.verify_first(_hinted(spark, d), "p_size", "p_partkey", "hint").where("turn is not null").select("p_size", "p_partkey", "turn")


SIGNALS = (("red", "colour", "urgent"), ("steel", "metal", "normal"), ("small", "size", "evergreen"))
_PROSE = """SELECT p_partkey, lower(p_name) AS h, CASE WHEN contains(lower(p_name), 'red') THEN 'colour' WHEN contains(lower(p_name), 'steel') THEN 'metal' WHEN contains(lower(p_name), 'small') THEN 'size' END AS area,
CASE WHEN contains(lower(p_name), 'red') THEN 'urgent' WHEN contains(lower(p_name), 'steel') THEN 'normal' WHEN contains(lower(p_name), 'small') THEN 'evergreen' ELSE 'normal' END AS urgency,
list_sort(list_distinct(['§ ' || (p_size % 9) || ' abs. 2'] || list_filter(['red', 'steel', 'small'], lambda x: contains(lower(p_name), x)))) AS tags, p_type, p_brand, p_size FROM part"""


def _prose(spark, d):
    text = F.concat(F.upper("p_name"), F.lit(" § "), (F.col("p_size") % 9).cast("string"), F.lit(" Abs. 2"))
    return table(spark, d, "part").withColumn("prose", P.prose_fingerprint(text, ("ring", "bolt"), SIGNALS))


@query("prose_fingerprints", f"SELECT p_partkey, array_to_string(list_filter(['bolt', 'ring'], lambda x: contains(h, x)), ',') AS countries, area, urgency, array_to_string(tags, ',') AS tags FROM ({_PROSE})")
def prose(spark, d):
    c = F.col("prose")
    return _prose(spark, d).select("p_partkey", F.array_join(c["countries"], ",").alias("countries"), c["legal_area"].alias("area"), c["urgency"].alias("urgency"), F.array_join(c["issue_tags"], ",").alias("tags"))


@query("case_fingerprints", f"""SELECT p_partkey, CASE WHEN f THEN p_brand ELSE array_to_string(list_filter(['bolt', 'ring'], lambda x: contains(h, x)), ',') END AS countries, CASE WHEN f AND p_size % 2 = 0 THEN 'Dublin' ELSE area END AS area,
CASE WHEN NOT f THEN urgency WHEN p_size % 2 = 0 OR urgency = 'urgent' THEN 'urgent' ELSE 'normal' END AS urgency, CASE WHEN f THEN p_type ELSE array_to_string(tags, ',') END AS tags FROM (SELECT *, p_partkey % 3 <> 0 AS f FROM ({_PROSE}))""")
def fingerprints(spark, d):
    """Two thirds of the cases have facets; half of these follow from a kind of proceedings that is urgent."""
    facets, even = F.col("p_partkey") % 3 != 0, F.col("p_size") % 2 == 0
    fp = P.fingerprint(F.col("prose"), F.when(facets, F.col("p_brand")), F.array().cast("array<string>"), F.when(facets, F.array("p_type")), F.when(even, "Dublin"), F.when(even, "urgent").otherwise("normal"))
    c = F.col("fp")
    return _prose(spark, d).withColumn("fp", fp).select("p_partkey", F.array_join(c["countries"], ",").alias("countries"), c["legal_area"].alias("area"), c["urgency"].alias("urgency"), F.array_join(c["issue_tags"], ",").alias("tags"))


@query("settled_proposals", "SELECT c_custkey, c_custkey * 10 + i AS id, CASE WHEN i = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 'mismatch' ELSE 'accepted' END WHEN c_custkey % 4 = 0 THEN CASE WHEN i = 1 THEN 'accepted' ELSE 'pending' END WHEN i = 1 THEN 'superseded' ELSE 'pending' END AS status FROM customer, unnest(range(0, 3)) AS t(i)")
def settled(spark, d):
    """Three proposals for each customer's document: the second says the same as the first, the third something new as well."""
    c = table(spark, d, "customer").select("c_custkey")
    k = F.col("c_custkey")
    targets = c.withColumn("version", F.lit(1)).withColumn("content", F.lit(json.dumps({"facts": ["old"], "title": "t"})))
    same, new = [{"op": "append", "path": "/facts", "value": "A  fact"}], [{"op": "append", "path": "/facts/-", "value": "a FACT"}, {"op": "append", "path": "/facts", "value": "more"}]
    each = c.select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i"))
    expected = F.when((F.col("i") == 0) & (k % 4 == 0), 7).otherwise(1)
    proposals = each.select("c_custkey", (k * 10 + F.col("i")).alias("id"), expected.alias("expected"), F.when(F.col("i") < 2, json.dumps(same)).otherwise(json.dumps(new)).alias("ops"))
    return M.settle(targets, proposals, "c_custkey", ["facts"], ["title"]).select("c_custkey", "id", "status")


@query("adopted_jobs", "SELECT o_orderkey, CASE WHEN l.k IS NOT NULL THEN 'done' WHEN o_orderkey % 5 >= 3 THEN 'failed' ELSE 'run' END AS next FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber = 5) l ON k = o_orderkey")
def adopted(spark, d):
    jobs = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("attempts"))
    made = table(spark, d, "lineitem").where("l_linenumber = 5").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("artifact"))
    return M.adopt(jobs, made, "o_orderkey", "attempts").select("o_orderkey", "next")


@query("profile_entities", """WITH k AS (SELECT c_custkey AS k, lpad((c_custkey % 90000 + 10000)::VARCHAR, 5, '0') AS p FROM customer) SELECT k, unnest(['birth_date', 'postal_code', 'city', 'street', 'azr_number', 'residence_permit', 'court_file', 'document_id', 'file_number']) AS type,
unnest(['1.2.19' || (50 + k % 40), p, 'Bad Ort', 'Lindenweg ' || (1 + k % 90), 'A' || (100000 + k), 'G-' || (10000 + k), (1 + k % 30) || ' K ' || (1 + k % 900) || '/21', 'X' || (70000 + k), (1000000 + k)::VARCHAR]) AS value FROM k UNION ALL SELECT k, 'case_number', 'A' || (100000 + k) FROM k UNION ALL SELECT k, 'case_number', 'X' || (70000 + k) FROM k""")
def profile_entities(spark, d):
    """What the case profile finds in letters made of customers; a cited judgment's number is not among it."""
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    letter = F.concat(
        F.lit("geboren am 1.2.19"), s(50 + k % 40), F.lit("; am 3.4.2020 kam er an.\nLindenweg "), s(1 + k % 90), F.lit(", "), F.lpad(s(k % 90000 + 10000), 5, "0"), F.lit(" Bad Ort.\nAZR-Nummer: A"), s(100000 + k),
        F.lit("\nAufenthaltsgestattung: G-"), s(10000 + k), F.lit("\nAz. "), s(1 + k % 30), F.lit(" K "), s(1 + k % 900), F.lit("/21\nUrteil vom 1.2.2020, Az. 9 K 99/19\nPassnummer: X"), s(70000 + k), F.lit("\nAkte: "), s(1000000 + k),
    )
    return A.case_entities(table(spark, d, "customer").select(k.alias("k"), letter.alias("t")), "k", "t").select("k", "type", "value")


@query("merged_entities", "SELECT user_id, event_type, string_agg(v, ',' ORDER BY e) AS vals FROM (SELECT user_id, event_type, lower('N' || event_id % 7) AS l, min(event_id) AS e, arg_min(CASE WHEN event_id % 2 = 0 THEN 'n' ELSE 'N' END || event_id % 7, event_id) AS v FROM events GROUP BY ALL) GROUP BY ALL")
def merged(spark, d):
    v = F.concat(F.lit(" "), F.when(F.col("event_id") % 2 == 0, "n").otherwise("N"), (F.col("event_id") % 7).cast("string"), F.lit(" "))
    return A.merge_entities(table(spark, d, "events").withColumn("v", v), ["user_id"], "event_type", "v", "event_id").select("user_id", "event_type", F.array_join("values", ",").alias("vals"))


@query("scrubbed_values", "SELECT p_partkey, replace(replace(p_name || '|' || p_type, 'small ring', '[X]'), 'ring', '[X]') AS line FROM part")
def scrubbed_values(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(A.scrub_values(F.array("p_name", "p_type"), F.array(F.lit("ring"), F.lit(""), F.lit("small ring")), "[X]"), "|").alias("line"))


@query("candidate_union", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'hybrid' ELSE 'recent' END AS origin FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def candidates(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    lists = [o.where("o_orderkey % 3 = 0").withColumn("origin", F.lit("hybrid")), o.where("o_orderkey % 2 = 0").withColumn("origin", F.lit("recent"))]
    return first_wins(lists, "o_orderkey", ["origin"])


@query("page_aliases", "WITH p AS (SELECT l_orderkey AS k, l_linenumber::INT AS n, l_orderkey % 4 + 2 AS s, CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey % 4 + 4 END AS e FROM lineitem), a AS (SELECT k, (s + row_number() OVER (PARTITION BY k ORDER BY n) - 1)::INT AS n, e FROM p) SELECT k, n FROM p UNION ALL SELECT k, n FROM a ANTI JOIN p USING (k, n) WHERE e IS NULL OR n <= e")
def aliases(spark, d):
    k = F.col("l_orderkey")
    pages = table(spark, d, "lineitem").select(k.alias("k"), F.col("l_linenumber").cast("int").alias("n"), (k % 4 + 2).alias("s"), F.when(k % 2 == 0, k % 4 + 4).alias("e"))
    return page_aliases(pages, "k", "n", "s", "e").select("k", "n")


_KEYS = f"SELECT page_id % 20 AS request, {_CANON} AS u, {_KEY} AS t FROM pages"


@query("ranking_counts", f"SELECT request, n::BIGINT AS input_count, m::BIGINT AS normalized_count, k AS deduped_count, (n - least(k, 10))::BIGINT AS filtered_count, least(k, 10) AS reranked_count FROM (SELECT request, count(*) AS n, count(*) FILTER (WHERE u <> '') AS m, count(DISTINCT (u, t)) FILTER (WHERE u <> '') AS k FROM ({_KEYS}) GROUP BY request)")
def ranking_counts(spark, d):
    """How many sources of each request are left after each step of the ranking."""
    p = _pages(spark, d).select("page_id", (F.col("page_id") % 20).alias("request"), "url", "title", F.lit("").alias("description"))
    return K.ranked(p, POLICY, 2026, ["request"], "page_id", 10)[1]


@query("ranked_sources")
def ranked_sources(spark, d):
    """The ten best sources of each request after deduplication, scoring and diversity."""
    p = _pages(spark, d).select("page_id", (F.col("page_id") % 20).alias("request"), "url", "title", F.lit("").alias("description"))
    return K.ranked(p, POLICY, 2026, ["request"], "page_id", 10)[0].select("request", "page_id", "place")
