"""Chunking, page maps, reassembly and interval queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators.merge import merge_intervals
from ..sources.tables import table
from .registry import query

_BLANK = r"[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]"
_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')"
_WINDOWS = f"""WITH w AS (SELECT doc_id, {_WORDS} AS t FROM documents), k AS (SELECT doc_id, t, len(t) AS n, CASE WHEN len(t) <= 500 THEN 0 ELSE CAST(ceil((len(t) - 500) / 400.0) AS INT) END AS last FROM w WHERE len(t) > 0),
e AS (SELECT doc_id, i AS idx, t, n FROM k, unnest(range(0, last + 1)) AS u(i))
SELECT doc_id, CAST(idx AS INT) AS idx, CAST(least(500, n - idx * 400) AS INT) AS n_tokens, md5(array_to_string(t[idx * 400 + 1 : idx * 400 + 500], ' ')) AS chunk_md5 FROM e WHERE n - idx * 400 >= 80"""


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("paragraphs", f"WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n+'), lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda x: length(x) >= 10) AS ps FROM documents) SELECT doc_id, CAST(i - 1 AS INT) AS idx, md5(ps[i]) AS paragraph_md5 FROM p, unnest(range(1, len(ps) + 1)) AS t(i)")
def paragraphs(spark, d):
    return C.paragraphs(_docs(spark, d), "text").select("doc_id", "idx", F.md5("paragraph").alias("paragraph_md5"))


@query("token_windows", _WINDOWS)
def token_windows(spark, d):
    return C.token_windows(_docs(spark, d), "text").select("doc_id", "idx", F.col("n_tokens").cast("int").alias("n_tokens"), F.md5("chunk").alias("chunk_md5"))


@query("chunk_payloads", f"WITH c AS ({_WINDOWS.replace('md5(array_to_string', 'length(array_to_string').replace('AS chunk_md5', 'AS chars')}) SELECT 'nc-' || substr(sha256(text), 1, 16) || '-' || lpad(CAST(idx AS VARCHAR), 3, '0') AS chunk_id, d.source || ' | ' || d.lang AS header, idx, chars FROM c JOIN documents d USING (doc_id)")
def chunk_payloads(spark, d):
    """Content-addressed ids, context headers and metadata of token windows."""
    w = C.token_windows(table(spark, d, "documents").select("doc_id", "text", "source", "lang"), "text")
    return w.select(C.chunk_id("nc", F.col("text"), F.col("idx")).alias("chunk_id"), F.concat_ws(" | ", F.col("source"), F.col("lang")).alias("header"), "idx", F.length("chunk").cast("long").alias("chars"))


@query("fixed_windows", "SELECT doc_id, CAST(i AS INT) AS idx, md5(substr(text, i * 700 + 1, 700)) AS window_md5 FROM documents, unnest(range(0, least(24, CAST(ceil(length(text) / 700.0) AS INT)))) AS t(i)")
def fixed_windows(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(C.fixed_windows(F.col("text"), 700)).alias("idx", "w")).select("doc_id", "idx", F.md5("w").alias("window_md5"))


def _paged(spark, d):
    """Documents as 600-character pages."""
    return _docs(spark, d).select("doc_id", F.posexplode(C.fixed_windows(F.col("text"), 600, None)).alias("p", "page_text")).select("doc_id", (F.col("p") + 1).alias("page_no"), "page_text")


_PAGED = "(SELECT doc_id, CAST(i + 1 AS INT) AS page_no, substr(text, i * 600 + 1, 600) AS page_text FROM documents, unnest(range(0, CAST(ceil(length(text) / 600.0) AS INT))) AS t(i))"


@query("page_split", f"SELECT doc_id, page_no, md5(page_text) AS page_md5 FROM {_PAGED}")
def page_split(spark, d):
    """Pages joined by form feeds come apart again."""
    texts = C.joined(_paged(spark, d), ["doc_id"], "page_no", "page_text", "\f")
    return C.pages(texts.select("doc_id", "text"), "text").select("doc_id", "page_no", F.md5("page_text").alias("page_md5"))


@query("page_headers", f"SELECT doc_id, page_no, md5(page_text || chr(10)) AS page_md5 FROM {_PAGED}")
def page_headers(spark, d):
    """Pages under header lines come apart at these."""
    marked = _paged(spark, d).withColumn("m", F.concat(F.lit("--- Seite "), F.col("page_no").cast("string"), F.lit(" ---\n"), F.col("page_text"), F.lit("\n")))
    texts = C.joined(marked, ["doc_id"], "page_no", "m", "")
    return C.pages(texts.select("doc_id", "text"), "text").select("doc_id", "page_no", F.md5("page_text").alias("page_md5"))


@query("page_groups", f"SELECT doc_id, CAST((page_no - 1) // 4 AS BIGINT) AS part, md5(string_agg(page_text, chr(10) || chr(10) ORDER BY page_no)) AS part_md5, count(*) AS n_pages FROM {_PAGED} GROUP BY ALL")
def page_groups(spark, d):
    held = _paged(spark, d).withColumn("part", F.floor((F.col("page_no") - 1) / 4))
    return C.joined(held, ["doc_id", "part"], "page_no", "page_text").select("doc_id", "part", F.md5("text").alias("part_md5"), F.col("n").alias("n_pages"))


@query("segment_text", f"SELECT doc_id, md5(string_agg(page_text, chr(10) || chr(10) ORDER BY page_no)) AS segment_md5, count(*) AS n_pages FROM {_PAGED} WHERE page_no BETWEEN 2 AND 2 + doc_id % 4 GROUP BY doc_id")
def segment_text(spark, d):
    """Pages of each document's segment, renumbered and joined; the segments come from a table of page ranges."""
    segments = _docs(spark, d).select("doc_id", F.lit(2).alias("start_page"), (2 + F.col("doc_id") % 4).alias("end_page"))
    inside = _paged(spark, d).join(segments, "doc_id").where("page_no between start_page and end_page").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")))
    return C.joined(inside.drop("n"), ["doc_id"], "page_no", "page_text").select("doc_id", F.md5("text").alias("segment_md5"), F.col("n").alias("n_pages"))


@query("reassembled_chunks", f"SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(page_text)) AS BIGINT) AS chars, md5(min_by(page_text, page_no)) AS first_md5 FROM {_PAGED} GROUP BY doc_id")
def reassembled(spark, d):
    g = _paged(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("page_text")).alias("chars"), F.md5(F.min_by("page_text", "page_no")).alias("first_md5"))
    return g


@query("budget_cut", f"SELECT doc_id, count(*) AS n_pages FROM (SELECT *, coalesce(sum(length(page_text)) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {_PAGED}) WHERE b < 2000 GROUP BY doc_id")
def budget_cut(spark, d):
    return C.until_budget(_paged(spark, d), ["doc_id"], "page_no", "page_text", 2000).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))


_IV = "(SELECT DISTINCT user_id, event_type, CAST(event_id % 200 AS INT) AS s, CAST(event_id % 200 + event_id % 7 AS INT) AS e FROM events)"


@query("merged_intervals", f"""WITH o AS (SELECT *, lag(event_type) OVER w AS pk, max(e) OVER (PARTITION BY user_id, event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {_IV} WINDOW w AS (PARTITION BY user_id ORDER BY s, e, event_type)),
i AS (SELECT *, sum(CASE WHEN pk IS NOT DISTINCT FROM event_type AND s <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e, event_type ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT user_id, event_type, min(s) AS s, max(e) AS e FROM i GROUP BY user_id, event_type, g""")
def merged_intervals(spark, d):
    """Page ranges of one kind that touch become one; ``events`` plays the ranges."""
    iv = table(spark, d, "events").select("user_id", "event_type", (F.col("event_id") % 200).cast("int").alias("s"), (F.col("event_id") % 200 + F.col("event_id") % 7).cast("int").alias("e")).distinct()
    return merge_intervals(iv, ["user_id"], "event_type", "s", "e").select("user_id", "event_type", "s", "e")


@query("clamped_segments", "SELECT l_orderkey, l_linenumber, least(l_suppkey % 12, 7)::INT AS end_page FROM lineitem WHERE l_linenumber >= 1 AND l_linenumber <= l_suppkey % 12 AND l_linenumber <= 7")
def clamped(spark, d):
    """Ranges that start inside a 7-page document, with their end moved inside."""
    e = F.col("l_suppkey") % 12
    rows = table(spark, d, "lineitem").where((F.col("l_linenumber") >= 1) & (F.col("l_linenumber") <= e) & (F.col("l_linenumber") <= 7))
    return rows.select("l_orderkey", "l_linenumber", F.least(e, F.lit(7)).cast("int").alias("end_page"))


@query("packed_chunks")
def packed(spark, d):
    return C.split_rows(_docs(spark, d), "doc_id", "text", C.pack).select("doc_id", "idx", F.length("chunk").alias("chars"))


@query("packed_lines")
def packed_lines(spark, d):
    return C.split_rows(_docs(spark, d), "doc_id", "text", C.pack_lines).select("doc_id", "idx", F.length("chunk").alias("chars"))


@query("sought_splits")
def sought(spark, d):
    return C.split_rows(_docs(spark, d), "doc_id", "text", lambda t: C.seek_split(t, 3000)).select("doc_id", "idx", F.length("chunk").alias("chars"))
