"""Facet matching and vocabulary queries; parts play decisions, brands countries, name words norms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators import matching as M
from ..operators import rendering as D
from ..sources.tables import table
from .registry import query

#: Cases: country, norms, themes, age, gender.
CASES = [(1, "BRAND#2", ["small", "RING", "ring"], ["economy"], 30, "F"), (2, "Brand#17", ["red", "widget", "red"], ["STANDARD", "PROMO", "promo"], 12, "m"), (3, None, ["blue", "bolt", "large"], [], 45, None), (4, "Brand#5", [], ["ECONOMY"], None, "f")]
_CASES = "(VALUES (1, 'BRAND#2', ['small','RING','ring'], ['economy'], 30, 'F'), (2, 'Brand#17', ['red','widget','red'], ['STANDARD','PROMO','promo'], 12, 'm'), (3, NULL, ['blue','bolt','large'], []::VARCHAR[], 45, NULL), (4, 'Brand#5', []::VARCHAR[], ['ECONOMY'], NULL, 'f')) AS c(case_id, country, norms, themes, age, gender)"
_P = "(SELECT p_partkey, p_brand, string_split(p_name, ' ') AS norms, [p_type] AS themes, p_partkey % 5 AS weight, p_partkey % 3000 AS age_days, p_size AS age, CASE p_partkey % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'm' END AS gender, p_partkey % 4 = 0 AS carries FROM part)"


def _cases(spark):
    return spark.createDataFrame(CASES, "case_id int, country string, norms array<string>, themes array<string>, age int, gender string")


def _parts(spark, d):
    k = F.col("p_partkey")
    gender = F.when(k % 3 == 0, "f").when(k % 3 == 1, "m")
    return table(spark, d, "part").select("p_partkey", "p_brand", F.split("p_name", " ").alias("p_norms"), F.array("p_type").alias("p_themes"), (k % 5).alias("weight"), (k % 3000).alias("age_days"), F.col("p_size").alias("p_age"), gender.alias("p_gender"), (k % 4 == 0).alias("carries"))


@query("overlap_pairs", f"SELECT case_id, p_partkey, len(list_distinct(list_intersect(c.norms, p.norms)))::BIGINT AS shared FROM {_CASES}, {_P} p WHERE len(list_intersect(c.norms, p.norms)) > 0")
def overlap(spark, d):
    return M.overlap_pairs(_cases(spark), _parts(spark, d).withColumnRenamed("p_norms", "norms"), "case_id", "p_partkey", "norms")


_FIT = f"""SELECT case_id, p_partkey, round(least(CASE WHEN lower(c.country) = lower(p.p_brand) THEN 0.35 ELSE 0 END::DOUBLE + 0.30::DOUBLE * (CASE WHEN len(c.norms) > 0 THEN len(list_filter(c.norms, lambda w: list_contains(list_transform(p.norms, lambda x: lower(x)), lower(w))))::DOUBLE / len(c.norms) ELSE 0 END)
 + 0.15::DOUBLE * (CASE WHEN len(c.themes) > 0 THEN len(list_filter(list_distinct(list_transform(c.themes, lambda x: lower(x))), lambda w: list_contains(list_transform(p.themes, lambda x: lower(x)), w)))::DOUBLE / len(list_distinct(list_transform(c.themes, lambda x: lower(x)))) ELSE 0 END) + 0.05::DOUBLE * least(weight, 3) + greatest(0, 0.08::DOUBLE * (1 - age_days / 1825.0::DOUBLE)), 1.0), 3) AS fit,
 (c.age IS NOT NULL)::INT + (c.gender IS NOT NULL AND p.gender IS NOT NULL)::INT AS compared, coalesce(abs(c.age - p.age) > 10, false)::INT + coalesce(lower(c.gender) <> lower(p.gender), false)::INT AS bad, carries FROM {_CASES}, {_P} p"""


def _scored(spark, d):
    both = _parts(spark, d).crossJoin(F.broadcast(_cases(spark)))  # four cases
    c = F.col
    value = M.fit(F.coalesce(fold(c("country")) == fold(c("p_brand")), F.lit(False)), M.norm_share(c("norms"), c("p_norms")), M.share(c("themes"), c("p_themes")), c("weight"), c("age_days"))
    compared = c("age").isNotNull().cast("int") + (c("gender").isNotNull() & c("p_gender").isNotNull()).cast("int")
    bad = M.mismatch("age", c("age"), c("p_age")).cast("int") + M.mismatch("gender", c("gender"), c("p_gender")).cast("int")
    return both.select("case_id", "p_partkey", value.alias("fit"), compared.alias("compared"), bad.alias("bad"), "carries")


@query("facet_scores", f"WITH f AS ({_FIT}) SELECT case_id, p_partkey, fit, CASE WHEN compared = 0 THEN 'ungeprueft' WHEN bad > 0 AND carries THEN 'hoch' WHEN bad > 0 THEN 'moeglich' ELSE 'niedrig' END AS risk FROM f")
def facet_scores(spark, d):
    return _scored(spark, d).select("case_id", "p_partkey", "fit", M.risk(F.col("compared"), F.col("bad"), F.when(F.col("carries"), F.col("bad")).otherwise(0)).alias("risk"))


@query("decision_packs", f"WITH f AS ({_FIT}) SELECT case_id, p_partkey, place FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY fit DESC, p_partkey) AS place FROM f) WHERE place <= 15")
def decision_packs(spark, d):
    """The fifteen best decisions of every case."""
    w = Window.partitionBy("case_id").orderBy(F.col("fit").desc(), "p_partkey")
    return _scored(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 15").select("case_id", "p_partkey", "place")


#: Norms in both dialects, made of part keys.
_NORMS = "(SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'AsylG § ' || (p_partkey % 40) || CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE '' END || ' Abs. 1' WHEN 1 THEN 'VO (EU) 2024/1347 Art. ' || (p_partkey % 20) WHEN 2 THEN 'VO (EU) 2024/1348 Artikel ' || (p_partkey % 70) WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN 'VO (EU) 2024/1348' ELSE 'Dublin III' END ELSE '§ 60 AufenthG' END AS norm FROM part)"
_BRIDGE = r"""CASE WHEN contains(n, 'asylg') THEN CASE WHEN sec IN ('3', '3a', '3b', '3c', '3d', '3e') THEN 'geas:fluechtling' WHEN sec = '4' THEN 'geas:subsidiaer' WHEN sec IN ('29', '29a') THEN 'geas:unzulaessig' WHEN sec IN ('30', '30a') THEN 'geas:offensichtlich' WHEN sec = '36' THEN 'geas:ou-verfahren' ELSE '' END
 WHEN contains(n, '2024/1347') THEN CASE WHEN art = '' THEN 'geas:fluechtling,geas:subsidiaer' WHEN art::INT BETWEEN 15 AND 17 THEN 'geas:subsidiaer' ELSE 'geas:fluechtling' END
 WHEN contains(n, '2024/1348') THEN CASE WHEN art = '' THEN 'geas:unzulaessig,geas:offensichtlich,geas:ou-verfahren' WHEN art::INT = 38 THEN 'geas:unzulaessig' WHEN art::INT IN (39, 42) THEN 'geas:offensichtlich' WHEN art::INT IN (67, 68) THEN 'geas:ou-verfahren' ELSE '' END
 WHEN contains(n, 'dublin') THEN 'geas:zustaendigkeit' ELSE '' END"""
_BRIDGED = rf"SELECT p_partkey, {_BRIDGE} AS tokens FROM (SELECT p_partkey, lower(norm) AS n, regexp_extract(lower(norm), '§\s*([0-9]+[a-z]?)', 1) AS sec, regexp_extract(lower(norm), 'art(?:ikel|\.)?\s*([0-9]+)', 1) AS art FROM {_NORMS})"


def _norms(spark, d):
    k = F.col("p_partkey")
    act = F.concat(F.lit("AsylG § "), (k % 40).cast("string"), F.when(k % 2 == 0, "a").otherwise(""), F.lit(" Abs. 1"))
    loose = F.when(k % 2 == 0, "VO (EU) 2024/1348").otherwise("Dublin III")
    norm = F.when(k % 5 == 0, act).when(k % 5 == 1, F.concat(F.lit("VO (EU) 2024/1347 Art. "), (k % 20).cast("string"))).when(k % 5 == 2, F.concat(F.lit("VO (EU) 2024/1348 Artikel "), (k % 70).cast("string")))
    return table(spark, d, "part").select("p_partkey", norm.when(k % 5 == 3, loose).otherwise("§ 60 AufenthG").alias("norm"))


@query("bridge_tokens", _BRIDGED)
def bridges(spark, d):
    return _norms(spark, d).select("p_partkey", F.array_join(M.bridge_tokens(F.col("norm")), ",").alias("tokens"))


@query("law_stale", f"SELECT p_partkey, tokens <> '' AND DATE '2026-06-01' + (p_partkey % 30)::INT < DATE '2026-06-12' AS stale FROM ({_BRIDGED})")
def law_stale(spark, d):
    """Decisions dated about the day on which the law changed."""
    decided = F.date_add(F.lit("2026-06-01").cast("date"), (F.col("p_partkey") % 30).cast("int"))
    return _norms(spark, d).select("p_partkey", M.law_stale(decided, F.array("norm"), F.lit("2026-06-12").cast("date")).alias("stale"))


@query("outcome_camps", "SELECT o_orderkey, CASE WHEN lower(o_orderstatus) IN ('f') THEN 'pro' WHEN lower(o_orderstatus) IN ('o') THEN 'gegen' ELSE 'neutral' END AS camp FROM orders")
def camps(spark, d):
    s = fold(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", F.when(s.isin("f"), "pro").when(s.isin("o"), "gegen").otherwise("neutral").alias("camp"))


@query("pack_freshness", "WITH g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS r, date_diff('day', max(o_orderdate)::DATE, DATE '2002-01-01') AS age FROM orders GROUP BY 1) SELECT c_custkey, CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < 5 THEN 'thin' WHEN age > 400 THEN 'stale' ELSE 'fresh' END AS state, round(least(1.0::DOUBLE, least(1.0::DOUBLE, coalesce(n, 0) / 15.0::DOUBLE) + CASE WHEN coalesce(r, 0) > 0 THEN 0.2::DOUBLE ELSE 0 END), 6) AS coverage FROM customer LEFT JOIN g ON o_custkey = c_custkey")
def freshness(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("r"), F.datediff(F.lit("2002-01-01").cast("date"), F.max("o_orderdate").cast("date")).alias("age"))
    n = F.coalesce("n", F.lit(0))
    return table(spark, d, "customer").join(g, "c_custkey", "left").select("c_custkey", M.freshness(n, 5, F.col("age"), F.lit(400)).alias("state"), F.round(M.coverage(n, 15, F.coalesce("r", F.lit(0))), 6).alias("coverage"))


@query("fingerprint_keys", "SELECT o_custkey, substr(lower(array_to_string(list_sort(list_distinct(list(o_orderpriority))), '|')), 1, 255) AS key FROM orders GROUP BY 1")
def fingerprint_keys(spark, d):
    keys = F.substring(fold(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|")), 1, 255)
    return table(spark, d, "orders").groupBy("o_custkey").agg(keys.alias("key"))


@query("folded_words", "SELECT doc_id, md5(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')) AS folded_md5 FROM documents")
def folded(spark, d):
    """Of every document."""
    return table(spark, d, "documents").select("doc_id", F.md5(fold(F.col("text"))).alias("folded_md5"))


ALIASES = [("small", "little"), ("little", "compact"), ("compact", "compact"), ("red", "crimson"), ("crimson", "crimson"), ("ring", "ring"), ("bolt", "fastener"), ("fastener", "fastener"), ("blue", "blue")]
_ALIAS = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ALIASES) + ") AS v(alias, target)"


@query("alias_closure", f"WITH RECURSIVE a AS (SELECT * FROM {_ALIAS}), r AS (SELECT alias, target, 1 AS n FROM a UNION ALL SELECT r.alias, a.target, n + 1 FROM r JOIN a ON a.alias = r.target AND a.target <> a.alias WHERE n < 8) SELECT alias, arg_max(target, n) AS target FROM r GROUP BY alias")
def alias_closure(spark, d):
    return M.closure(spark.createDataFrame(ALIASES, "alias string, target string"))


@query("canonical_terms", "WITH v(alias, target) AS (VALUES ('small','compact'),('little','compact'),('compact','compact'),('red','crimson'),('crimson','crimson'),('ring','ring'),('bolt','fastener'),('fastener','fastener'),('blue','blue')), e AS (SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1) AS p, unnest(string_split(p_name, ' ')) AS t FROM part), f AS (SELECT p_partkey, target, min(p) AS p FROM e JOIN v ON lower(trim(t)) = alias GROUP BY ALL) SELECT p_partkey, string_agg(target, ',' ORDER BY p) AS names FROM f GROUP BY 1")
def canonical_terms(spark, d):
    vocab = M.closure(spark.createDataFrame(ALIASES, "alias string, target string"))
    rows = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("terms"))
    return M.canonical(rows, vocab, ["p_partkey"], "terms").select("p_partkey", F.array_join("names", ",").alias("names"))


@query("vocabulary", "SELECT lower(w) AS term, count(*) AS n, min_by(w, p_partkey * 10 + i) AS shown FROM (SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1) AS i, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1 HAVING count(*) >= 5")
def vocabulary(spark, d):
    """Terms seen often enough with the form in which each was first seen."""
    each = table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "w"))
    g = each.groupBy(F.lower("w").alias("term")).agg(F.count(F.lit(1)).alias("n"), F.min_by("w", F.col("p_partkey") * 10 + F.col("i") + 1).alias("shown"))
    return g.where("n >= 5")


@query("window_facets", "WITH c AS (SELECT user_id, event_type AS term, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, term, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, term) AS place FROM c) WHERE place <= 12")
def window_facets(spark, d):
    """Facets of a document's windows merged by frequency; events play the windows."""
    return M.majority(table(spark, d, "events"), ["user_id"], "event_type", "event_id").select("user_id", F.col("event_type").alias("term"), "place")


@query("instance_weights", "SELECT doc_id, CASE WHEN contains(source, '19') THEN 3 WHEN contains(source, '1') THEN 2 WHEN contains(source, 'src') THEN 1 ELSE 0 END AS weight FROM documents")
def weights(spark, d):
    s = F.col("source")
    return table(spark, d, "documents").select("doc_id", F.when(s.contains("19"), 3).when(s.contains("1"), 2).when(s.contains("src"), 1).otherwise(0).alias("weight"))


@query("merged_facets", "SELECT c_custkey, coalesce(nullif(trim(c_mktsegment), ''), 'none') AS segment, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 99 ELSE c_nationkey END AS nation FROM customer")
def merged(spark, d):
    """Fill-only for the segment; an override for the nation, in which a sent null deletes."""
    sent, value = F.col("c_custkey") % 15 % 5 == 0, F.when(F.col("c_custkey") % 3 == 0, 99)
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.expr("nullif(trim(c_mktsegment), '')"), F.lit("none")).alias("segment"), F.when(~sent, F.coalesce(value, F.col("c_nationkey"))).alias("nation"))


@query("coerced_ages", "SELECT event_id, CASE WHEN try_cast(v AS INT) BETWEEN 1 AND 120 THEN try_cast(v AS INT) END AS age, CASE WHEN event_type IN ('click', 'view') THEN true WHEN event_type = 'error' THEN false END AS flag FROM (SELECT event_id, event_type, regexp_extract(props, '([0-9]+)', 1) AS v FROM events)")
def coerced(spark, d):
    age = F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS INT)")
    flag = F.when(F.col("event_type").isin("click", "view"), True).when(F.col("event_type") == "error", False)
    return table(spark, d, "events").select("event_id", F.when(age.between(1, 120), age).alias("age"), flag.alias("flag"))


@query("stale_decisions", "WITH c(region, cut) AS (VALUES (0, DATE '1996-01-01'), (1, DATE '1998-06-01'), (2, DATE '2000-01-01')) SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN c ON region = n_regionkey WHERE o_orderdate < cut")
def stale(spark, d):
    """Orders before their region's cut-off date."""
    import datetime as dt

    cut = spark.createDataFrame([(0, dt.date(1996, 1, 1)), (1, dt.date(1998, 6, 1)), (2, dt.date(2000, 1, 1))], "n_regionkey int, cut date")
    region = table(spark, d, "nation").join(cut, "n_regionkey").select(F.col("n_nationkey").alias("c_nationkey"), "cut")
    c = table(spark, d, "customer").join(region, "c_nationkey").select(F.col("c_custkey").alias("o_custkey"), "cut")
    return table(spark, d, "orders").join(c, "o_custkey").where(F.col("o_orderdate") < F.col("cut")).select("o_orderkey")


_ENTRY = "'Entscheidung ' || o_orderkey || ': ' || repeat(o_orderpriority || ' ', CAST(o_orderkey % 23 + 1 AS INT))"
_NOTE = "CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || '- Unterscheidbar: dort abweichend — Alter, Geschlecht' ELSE '' END WHEN o_orderkey % 5 = 1 THEN chr(10) || '- RISIKO: leicht zu unterscheiden — Entscheidung trägt auf: ' || CASE WHEN o_orderkey % 3 = 0 THEN 'Alter, Geschlecht' ELSE '' END WHEN o_orderstatus = 'P' THEN chr(10) || '- Hinweis: Ergebnis unklar/ungeprüft — nicht ungeprüft zitieren' WHEN o_orderkey % 3 = 0 THEN chr(10) || '- Hinweis: Profil weicht ab (Alter, Geschlecht)' ELSE '' END"


@query("decision_blocks", f"""WITH RECURSIVE h AS (SELECT ['## STÜTZEND', '## STÜTZEND MIT VORSICHT (Distinguish-Risiko)', '## GEGEN UNS'] AS t),
s AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderkey % 7 = 0 AS stale, CASE WHEN o_orderstatus = 'F' THEN 3 WHEN o_orderstatus = 'O' AND o_orderkey % 5 IN (0, 2) AND o_orderkey % 7 <> 0 THEN 1 ELSE 2 END AS sec, {_ENTRY} AS body, {_NOTE} AS note FROM orders),
e AS (SELECT o_custkey, sec, body || CASE WHEN sec > 1 THEN note ELSE '' END AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY sec, stale, o_totalprice DESC, o_orderkey) AS i FROM s),
r AS (SELECT DISTINCT o_custkey, CAST(0 AS BIGINT) AS i, CAST(1500 AS BIGINT) AS room, 0 AS sec, false AS here, '' AS block, CAST(0 AS BIGINT) AS n FROM e
  UNION ALL SELECT o_custkey, i, room - CASE WHEN fits THEN length(x) ELSE 0 END, now, same OR fits, block || CASE WHEN NOT fits THEN '' WHEN same THEN chr(10) || chr(10) || x ELSE CASE WHEN block = '' THEN '' ELSE chr(10) || chr(10) END || h.t[now] || chr(10) || chr(10) || x END, n + CAST(fits AS BIGINT)
  FROM (SELECT *, length(x) + length(h.t[now]) <= room AS fits FROM (SELECT e.o_custkey, e.i, e.x, e.sec AS now, r.room - CASE WHEN e.sec <> r.sec AND r.here THEN length(h.t[r.sec]) ELSE 0 END AS room, e.sec = r.sec AND r.here AS same, r.block, r.n FROM r JOIN e ON e.o_custkey = r.o_custkey AND e.i = r.i + 1, h), h), h)
SELECT o_custkey, md5(arg_max(block, i)) AS block_md5, max(n) AS entries FROM r GROUP BY o_custkey""")
def decision_blocks(spark, d):
    """For each customer the orders as decisions: what supports, what can be told apart, what is against, under one budget."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    camp = F.when(F.col("o_orderstatus") == "O", "pro").when(F.col("o_orderstatus") == "F", "gegen").otherwise("neutral")
    risk = F.when(k % 5 == 1, "hoch").when(k % 5 == 0, "niedrig").when(k % 5 == 2, "ungeprueft").otherwise("moeglich")
    differing = F.when(k % 3 == 0, F.array(F.lit("alter"), F.lit("geschlecht")))
    note = D.risk_note(camp, risk, F.lit(None).cast("array<string>"), differing)
    section = D.decision_section(camp, risk, k % 7 == 0)
    body = F.concat(F.lit("Entscheidung "), k.cast("string"), F.lit(": "), F.repeat(F.concat("o_orderpriority", F.lit(" ")), (k % 23 + 1).cast("int")))
    entries = o.select("o_custkey", section.alias("section"), (k % 7 == 0).alias("stale"), "o_totalprice", "o_orderkey", F.when((section > 0) & (note != ""), F.concat(body, F.lit("\n"), note)).otherwise(body).alias("entry"))
    blocks = D.sectioned(entries, "o_custkey", "section", [F.col("stale"), -F.col("o_totalprice"), k], "entry", budget=1500)
    return blocks.select("o_custkey", F.md5("block").alias("block_md5"), "entries")
