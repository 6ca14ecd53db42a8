"""The registered queries of the corpus operators, thin views over their results, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialize
    from .fingerprints import edited_fingerprints, with_neighbours

    prints = materialize(edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")), "prints")
    return with_neighbours(prints, F.col("doc_id") % 20 == 0).drop("f1", "f2")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    out = shard(docs.withColumn("text_crc32", crc))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import judge, mine

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = mine(pages, table(spark, sf_dir, "labels"), "page_id", "url", "doc_id", "quality")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import decode, encode

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern), path, pattern)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x),
reach AS (SELECT x AS a, x AS b FROM link UNION SELECT a, y FROM reach JOIN link ON b = x),
comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(m, vec_id) AS component_id, vec_id = coalesce(m, vec_id) AS kept
FROM v LEFT JOIN n ON x = vec_id LEFT JOIN comp ON a = vec_id
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, i, ls[i] AS line, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
bad AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT l.*, keeper IS NOT NULL AND l.doc_id <> keeper AS gone FROM l LEFT JOIN bad USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY rid
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS DOUBLE) AS total, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, 2 * total / w AS ratio FROM t),
l AS (SELECT *, (1.5 * sum(total) OVER () - coalesce(sum(2 * total) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS level
  FROM r WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, total, least(2 * total, coalesce((SELECT min_by(level, ratio) FROM l WHERE level <= ratio), ratio) * w) AS target FROM l),
h AS (SELECT source, CAST(total AS BIGINT) AS total, target, CASE WHEN total > 0 THEN CAST(floor(target / total) AS BIGINT) ELSE 0 END AS passes FROM g),
m AS (SELECT d.*, h.total, h.target, h.passes, CAST(floor(h.target) AS BIGINT) - h.passes * h.total AS rest,
  sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, total AS source_size, target, CAST(passes * size + least(size, greatest(0, rest - before)) AS BIGINT) AS taken FROM m
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT rid, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h FROM w, unnest(range(1, len(ws) - 33)) AS t(i)),
bad AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT rid, i + k AS p FROM bad, unnest(range(0, 35)) AS t(k)),
pos AS (SELECT rid, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM pos ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)
"""


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x AS a, x AS b FROM both_ways UNION SELECT a, y FROM reach JOIN both_ways ON b = x),
comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, doc_id) AS component_id, doc_id = coalesce(m, doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp ON a = doc_id
"""



def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    return align(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bitsliced import build_index, search

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(build_index(vectors, F.col("vec_id") % 50 == 0), k=5)


OP12_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import audit, damaged, digests, repaired

    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = damaged(given)
    audits = audit(turns)
    hashes = digests(repaired(turns, audits)).withColumnRenamed("conv_id", "_c")
    out = given.select(F.col("conv_id").alias("_id")).distinct().join(audits, F.col("_id").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("_id").eqNullSafe(F.col("_c")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in counts} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))}
    return out.select(F.col("_id").alias("conv_id"), *(v.alias(c) for c, v in zeros.items()))


def _op13_sql() -> str:
    """The same Viterbi layers as a recursive query; a state is its cost in nine digits followed by its audit string."""
    edit = lambda state, cost, letter: f"(lpad(CAST(CAST({state}[1:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') || {state}[10:] || '{letter}')"
    kept = lambda state, initial: f"CASE WHEN free AND initial = '{initial}' THEN {edit(state, '5 * unended', 'K')} END"
    rerole = lambda state: f"CASE WHEN free THEN {edit(state, '1 + 5 * unended', 'R')} END"
    to_user = ", ".join(f"{kept(x, 'u')}, {rerole(x)}" for x in ("c0", "c1", "c3"))
    space = r"\x20\x09-\x0D"
    return rf"""
WITH RECURSIVE g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ord(k[i]) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda z, j: xor(z >> 1, (z & 1) * 3988292384))), CAST(4294967295 AS BIGINT)) % 20 AS fate FROM g),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(n)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 32), left(sha256(text), 32)) AS i FROM d),
f AS (SELECT *, role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS previous, NOT regexp_matches(text, '[^{space}]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][{space}]*$') AS open_end FROM o),
r AS (SELECT *, NOT blank AND NOT again AS free, CAST(open_end AND NOT blank AND NOT again AS INTEGER) AS unended FROM f),
v AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS c0, CAST(NULL AS VARCHAR) AS c1, '000000005I' AS c2, '000000010II' AS c3 FROM r
  UNION ALL SELECT conv_id, i, n0, n1, m2, least(n3, {edit("m2", 5, "I")}) FROM
    (SELECT *, least(n2, {edit("n0", 5, "I")}, {edit("n1", 5, "I")}, {edit("n3", 5, "I")}) AS m2 FROM
      (SELECT r.conv_id, r.i, {edit("c0", 2, "D")} AS n0, least({edit("c1", 2, "D")}, {kept("c0", "s")}) AS n1,
        least({edit("c2", 2, "D")}, {to_user}) AS n2, least({edit("c3", 2, "D")}, {kept("c2", "a")}, {rerole("c2")}) AS n3
       FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i + 1))),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
  sum(unended) AS truncated, count(*) FILTER (WHERE i > 1 AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
e AS (SELECT n.*, least(c0, c3) AS w FROM n JOIN v ON v.conv_id IS NOT DISTINCT FROM n.conv_id AND v.i = n.n),
l AS (SELECT conv_id, p, w[9 + p] AS letter, p - length(replace(w[10:9 + p], 'I', '')) AS inserted, length(replace(w[10:8 + p], 'D', '')) AS place FROM e, unnest(range(1, length(w) - 8)) AS t(p)),
m AS (SELECT l.*, r.role, r.text, max(CASE WHEN place = 0 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS lead
  FROM l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND letter <> 'I' AND r.i = p - inserted),
t AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - lead) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS hash
  FROM m WHERE letter <> 'D' GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w[1:9], '0') AS BIGINT) AS cost, coalesce(w[10:], '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_sharding": op2_sharding,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_url_filters": op4_url_filters,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_mixing": op8_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_exact_search": op12_exact_search,
    "op13_conversation_repair": op13_conversation_repair,
}
SQL: dict[str, str] = {"op13_conversation_repair": _op13_sql(), "op12_exact_search": OP12_SQL, "op6_embedding_near_dedup": OP6_SQL, "op8_mixing": OP8_SQL, "op7_line_dedup": OP7_SQL, "op9_substring_dedup": OP9_SQL, "op10_minhash_near_dedup": OP10_SQL}
