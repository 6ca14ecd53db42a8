"""Retrieval queries: exact nearest neighbours, postings, fusion, chat history and tag matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lexical as L
from ..operators import retrieval as R
from ..scratch import cut
from ..sources.tables import dealt, table
from .registry import query

_COS = "list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))"
_KNN = """knn AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
(SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))) AS score
 FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0) q))"""


def _knn(spark, d, k, by=None):
    """Every vector whose id is divisible by 20 asks all vectors, itself among them."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.knn(e, asked, "vec_id", "embedding", k, by)


@query("dense_knn", f"WITH {_KNN} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM knn WHERE rank <= 20")
def dense_knn(spark, d):
    return _knn(spark, d, 20).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


_BM = r"""idx AS (SELECT doc_id, term, count(*) AS tf, any_value(len(t)) AS length FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents), unnest(t) AS u(term) GROUP BY doc_id, term),
st AS (SELECT count(*) AS n, avg(length) AS mean FROM (SELECT DISTINCT doc_id, length FROM idx)),
df AS (SELECT term, count(*) AS df FROM idx GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM benchmark), unnest(t) AS u(term)),
bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id,
 round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM idx JOIN q USING (term) JOIN df USING (term), st GROUP BY query_id, doc_id))"""


def _bm25(spark, d, k):
    """Every whole benchmark passage asks all documents."""
    docs = dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(R.terms_of(F.col("text"))).alias("term"))
    return R.bm25_search(docs, asked, "doc_id", "text", k)


@query("sparse_bm25", f"WITH {_BM} SELECT query_id, doc_id, rank FROM bm WHERE rank <= 5")
def sparse_bm25(spark, d):
    return _bm25(spark, d, 5).select("query_id", "doc_id", "rank")


@query("rank_fusion", f"""WITH {_KNN}, {_BM}, a AS (SELECT query_id, vec_id AS id, rank AS dr FROM knn WHERE rank <= 50), b AS (SELECT query_id, doc_id AS id, rank AS sr FROM bm WHERE rank <= 50),
f AS (SELECT query_id, id, dr, sr, coalesce(1.0::DOUBLE / (60 + dr), 0) + coalesce(1.0::DOUBLE / (60 + sr), 0) AS s FROM a FULL JOIN b USING (query_id, id))
SELECT query_id, id, rank, round(s, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, dr NULLS LAST, sr NULLS LAST, id) AS rank FROM f) WHERE rank <= 50""")
def rank_fusion(spark, d):
    """Dense and sparse lists of 50 for each query, fused and capped before a reranker would see them."""
    return _fused(spark, d).select("query_id", "id", "rank", F.round("score", 9).alias("score"))


def _fused(spark, d):
    dense = _knn(spark, d, 50).withColumnRenamed("vec_id", "id")
    sparse = _bm25(spark, d, 50).withColumnRenamed("doc_id", "id")
    return R.fuse(dense, sparse, "id").where("rank <= 50")


@query("reranked")
def reranked(spark, d):
    """Fused hits in the order of an external scorer; the stand-in counts shared words.

    Hits without a text, and those of queries without one, cannot be scored: they follow in the order of the fusion.
    """
    hits = cut(_fused(spark, d).select("query_id", "id", "rank"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).where("query is not null")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").where("text is not null")
    named = R.sent_to(docs, hits.join(asked, "query_id", "left_semi"), "id").join(asked, "query_id")
    scored = R.rerank(named, lambda q, t: [float(len(set(a.split()) & set(b.split()))) for a, b in zip(q, t, strict=True)], "query", "text")
    w = Window.partitionBy("query_id").orderBy(F.coalesce("rerank_score", F.lit(float("-inf"))).desc(), "rank")
    every = hits.join(scored.select("query_id", "id", "rerank_score"), ["query_id", "id"], "left")
    return every.withColumn("place", F.row_number().over(w)).where("place <= 5").select("query_id", F.col("id").alias("doc_id"), "place")


@query("distinct_passages", f"""WITH {_BM}, h AS (SELECT bm.query_id, bm.doc_id, rank, sha256(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) AS s FROM bm JOIN documents USING (doc_id) WHERE rank <= 10),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, s ORDER BY rank) = 1) SELECT query_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM o) WHERE place <= 6""")
def distinct_passages(spark, d):
    hits = R.sent_to(table(spark, d, "documents").select("doc_id", "text"), _bm25(spark, d, 12), "doc_id")
    return R.distinct_passages(hits, "text", 6).select("query_id", "doc_id", "place")


@query("collections_ask", f"WITH {_KNN} SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY label, r) AS number FROM (SELECT knn.*, label, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS r FROM knn JOIN embeddings USING (vec_id)) WHERE r <= 8")
def collections_ask(spark, d):
    """Eight hits of every collection, numbered through in collection order."""
    few = _knn(spark, d, 8, "label")
    return few.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("label", "rank"))).select("query_id", "vec_id", "number")


@query("best_chunk_per_label", f"WITH {_KNN} SELECT query_id, label, round(max(score), 6) AS score FROM knn JOIN embeddings USING (vec_id) GROUP BY ALL")
def best_chunk(spark, d):
    """Chunks to their entry with the best score of each."""
    return _knn(spark, d, 1, "label").select("query_id", "label", F.round("score", 6).alias("score"))


@query("blended_relevance", f"WITH {_KNN} SELECT query_id, vec_id, round(score + 0.05 * (label % 4) + greatest(0, 0.2 * (1 - (vec_id * 9) / 3650.0)), 6) AS blended FROM knn JOIN embeddings USING (vec_id) WHERE rank <= 20")
def blended(spark, d):
    """Relevance plus instance weight plus freshness that fades over ten years; ids stand in for age in days."""
    hits = _knn(spark, d, 20).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    fresh = F.greatest(F.lit(0.0), 0.2 * (1 - F.col("vec_id") * 9 / 3650.0))
    return hits.select("query_id", "vec_id", F.round(F.col("score") + 0.05 * (F.col("label") % 4) + fresh, 6).alias("blended"))


@query("chat_history", "SELECT conv_id, turn, role, length(content)::BIGINT AS chars FROM (SELECT conv_id, turn, role, substr(trim(text), 1, 4000) AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '') WHERE r <= 12")
def chat_history(spark, d):
    """The last twelve usable turns of every conversation, 4,000 characters of each at most."""
    c = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    r = c.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))).where("r <= 12")
    return r.select("conv_id", "turn", "role", F.length(F.substring(F.trim("text"), 1, 4000)).cast("long").alias("chars"))


@query("citation_markers", r"SELECT conv_id, turn, NOT regexp_matches(coalesce(text, ''), '\[Q[0-9]+\]') AS unproven FROM conversations WHERE role = 'assistant'")
def markers(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", (~F.coalesce("text", F.lit("")).rlike(r"\[Q[0-9]+\]")).alias("unproven"))


@query("tag_matches", "WITH t AS (SELECT DISTINCT p_partkey, string_split(p_name, ' ') AS tags FROM part) SELECT l.o_orderpriority AS hay, p_partkey, len(list_filter(tags, lambda x: contains('red blue small ring bolt', x)))::BIGINT AS hits FROM t, (SELECT DISTINCT o_orderpriority FROM orders) l WHERE len(list_filter(tags, lambda x: contains('red blue small ring bolt', x))) >= 1 QUALIFY row_number() OVER (PARTITION BY hay ORDER BY hits DESC, p_partkey) <= 10")
def tag_matches(spark, d):
    """Entries whose tags occur in a text, the most hits first, ten per case; the text is the same in all."""
    tags = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("tags"))
    cases = table(spark, d, "orders").select(F.col("o_orderpriority").alias("hay")).distinct()
    hits = F.size(F.filter("tags", lambda x: F.lit("red blue small ring bolt").contains(x))).cast("long")
    top = tags.withColumn("hits", hits).where("hits >= 1").orderBy(F.col("hits").desc(), "p_partkey").limit(10)
    return cases.crossJoin(F.broadcast(top)).select("hay", "p_partkey", "hits")


_WORD = lambda k: f"t[{k}]"
_PAIR = lambda a, b: f"contains(w, ' ' || {_WORD(a)} || ' ' || {_WORD(b)} || ' ')"
_HAS = lambda k: f"contains(w, ' ' || {_WORD(k)} || ' ')"
_WEB = rf"""q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM benchmark),
d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), ' ') || ' ' AS w FROM documents),
m AS (SELECT query_id, doc_id FROM q, d WHERE ({_PAIR(1, 2)} AND {_HAS(3)} AND NOT {_HAS(12)}) OR ({_HAS(5)} AND {_PAIR(6, 7)}))"""


def _web(spark, d):
    """Web search queries made of the passages: ``"a b" c -l or e f-g``."""
    t = R.terms_of(F.col("text"))
    at = lambda k: F.get(t, F.lit(k - 1))
    said = F.concat(F.lit('"'), at(1), F.lit(" "), at(2), F.lit('" '), F.upper(at(3)), F.lit(" -"), at(12), F.lit(" OR "), at(5), F.lit(" "), at(6), F.lit("-"), at(7))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), said.alias("said"))


@query("web_matches", f"WITH {_WEB} SELECT * FROM m")
def web_matches(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return R.web_matches(docs, R.parse_queries(_web(spark, d), "query_id", "said"), "doc_id", "text")


@query("web_search", rf"""WITH {_WEB}, i AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM documents) GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS length FROM i GROUP BY 1), st AS (SELECT count(*) AS n, avg(length) AS mean FROM l), df AS (SELECT term, count(*) AS df FROM i GROUP BY 1),
a AS (SELECT DISTINCT query_id, unnest([t[1], t[2], t[3], t[5], t[6], t[7]]) AS term FROM q),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM a JOIN i USING (term) JOIN df USING (term) JOIN l USING (doc_id), st GROUP BY ALL)
SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s SEMI JOIN m USING (query_id, doc_id)) WHERE rank <= 10""")
def web_search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return R.web_search(docs, _web(spark, d), "doc_id", "text", "said", 10).select("query_id", "doc_id", "rank")


@query("cover_search", rf"""WITH {_WEB}, i AS (SELECT doc_id, term, pos FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), 1) AS pos FROM documents)),
b AS (SELECT DISTINCT query_id, 1 AS branch, unnest([t[1], t[2], t[3]]) AS term FROM q UNION SELECT DISTINCT query_id, 2, unnest([t[5], t[6], t[7]]) FROM q),
o AS (SELECT query_id, branch, count(*) AS need FROM b GROUP BY ALL),
h AS (SELECT DISTINCT query_id, doc_id, branch, term, pos FROM m JOIN b USING (query_id) JOIN i USING (doc_id, term)),
full_ AS (SELECT query_id, doc_id, branch FROM h JOIN o USING (query_id, branch) GROUP BY ALL HAVING count(DISTINCT term) = any_value(need)),
e AS (SELECT DISTINCT query_id, doc_id, pos AS p FROM h SEMI JOIN full_ USING (query_id, doc_id, branch)),
n AS (SELECT query_id, doc_id, p, branch, term, min(pos) AS nxt FROM e JOIN h USING (query_id, doc_id) WHERE pos >= p GROUP BY ALL),
w AS (SELECT query_id, doc_id, p, branch, max(nxt) AS last FROM n JOIN o USING (query_id, branch) GROUP BY ALL HAVING count(*) = any_value(need)),
c AS (SELECT query_id, doc_id, p, min(last) AS last FROM w GROUP BY ALL),
k AS (SELECT *, lead(last) OVER (PARTITION BY query_id, doc_id ORDER BY p) AS later FROM c),
s AS (SELECT k.query_id, k.doc_id, round(sum(0.1 / (1 + (k.last - k.p + 1) - (SELECT count(*) FROM e WHERE e.query_id = k.query_id AND e.doc_id = k.doc_id AND e.p BETWEEN k.p AND k.last))), 6) AS score FROM k WHERE later IS NULL OR last < later GROUP BY ALL)
SELECT query_id, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def cover_search(spark, d):
    """The web search queries, ranked by how densely texts cover them."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return R.cover_search(docs, _web(spark, d), "doc_id", "text", "said", 10).select("query_id", "doc_id", "rank", "score")


@query("stemmed_cover_search")
def stemmed_cover_search(spark, d):
    """The same over stems."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return R.cover_search(docs, _web(spark, d), "doc_id", "text", "said", 10, L.stemmed_terms).select("query_id", "doc_id", "rank", "score")
