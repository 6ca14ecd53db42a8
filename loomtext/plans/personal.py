"""Recognition, redaction and leak checks on documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import privacy as P
from ..operators import spans as S
from ..sources.tables import table
from .registry import query

_LIT = lambda p: p.replace("'", "''")
_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{t}' AS type, {s}::DOUBLE AS score, unnest(list_distinct(regexp_extract_all(text, '{_LIT(p)}', 1))) AS value FROM documents" for t, p, s in P.RULES)
_RED = "text"
for _p, _t in P.REDACTIONS:
    _RED = f"regexp_replace({_RED}, '{_LIT(_p)}', '{_t}', 'g')"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("recognised", f"SELECT doc_id, type, value, score FROM ({_FOUND})")
def recognised(spark, d):
    return P.recognise(_docs(spark, d), "doc_id", "text").select("doc_id", "type", "value", "score")


@query("exclusive_entities", f"SELECT doc_id, type, value FROM ({_FOUND}) QUALIFY row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(value, '[^\\p{{L}}\\p{{N}}]', '', 'g')) ORDER BY score DESC, type, value) = 1")
def exclusive(spark, d):
    return P.exclusive(P.recognise(_docs(spark, d), "doc_id", "text"), "doc_id").select("doc_id", "type", "value")


@query("entity_counts", f"SELECT doc_id, count(*) FILTER (WHERE type = 'email') AS emails, count(*) FILTER (WHERE type IN ('phone', 'short_phone')) AS phones, count(*) AS n FROM ({_FOUND}) GROUP BY doc_id")
def entity_counts(spark, d):
    e = P.recognise(_docs(spark, d), "doc_id", "text")
    return e.groupBy("doc_id").agg(F.count(F.when(F.col("type") == "email", 1)).alias("emails"), F.count(F.when(F.col("type").isin("phone", "short_phone"), 1)).alias("phones"), F.count(F.lit(1)).alias("n"))


@query("redacted", f"SELECT doc_id, md5({_RED}) AS redacted_md5 FROM documents")
def redacted(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(P.redact(F.col("text"))).alias("redacted_md5"))


@query("placeholder_counts", f"SELECT doc_id, len(regexp_extract_all(r, '\\[EMAIL\\]'))::BIGINT AS emails, len(regexp_extract_all(r, '\\[[A-Z]+\\]'))::BIGINT AS n FROM (SELECT doc_id, {_RED} AS r FROM documents)")
def placeholders(spark, d):
    r = _docs(spark, d).select("doc_id", P.redact(F.col("text")).alias("r"))
    return r.select("doc_id", F.regexp_count("r", F.lit(r"\[EMAIL\]")).cast("long").alias("emails"), F.regexp_count("r", F.lit(r"\[[A-Z]+\]")).cast("long").alias("n"))


@query("leak_check", f"WITH e AS (SELECT doc_id, list(value) AS vs FROM ({_FOUND}) WHERE type IN ('email', 'secret', 'phone') GROUP BY doc_id) SELECT doc_id, len(list_filter(vs, lambda x: contains(lower(regexp_replace({_RED}, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lower(regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')))))::BIGINT AS leaks FROM documents JOIN e USING (doc_id)")
def leak_check(spark, d):
    docs = _docs(spark, d)
    e = P.recognise(docs, "doc_id", "text").where(F.col("type").isin("email", "secret", "phone")).groupBy("doc_id").agg(F.collect_list("value").alias("vs"))
    return docs.join(e, "doc_id").select("doc_id", P.leaks(P.redact(F.col("text")), F.col("vs")).cast("long").alias("leaks"))


@query("entities_redacted")
def entities_redacted(spark, d):
    """Each document without the names that its case knows: its long words that begin with a capital, and every two neighbours of these as a full name."""
    word = r"\p{Lu}\p{Ll}{5,}"
    docs = _docs(spark, d).withColumn("terms", F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(rf"\b({word})\b"), F.lit(1)), F.regexp_extract_all("text", F.lit(rf"\b({word} {word})\b"), F.lit(1)))))
    return P.redact_entities(docs, "text", "terms").select("doc_id", F.regexp_count("redacted", F.lit(r"\[PERSON\]")).alias("hits"), F.md5("redacted").alias("redacted_md5"))


_LETTERS = lambda c, first: f"'{first}' || translate(CAST({c} AS VARCHAR), '0123456789', 'qxwzvkyjfg') || 'q'"
_FIRST, _LAST = _LETTERS("doc_id", "Qyxz"), _LETTERS("doc_id", "Xqzw")
_FORMS = ("{f} || ' ' || {l}", "{l} || ', ' || {f}", "{l} || chr(10) || {f}", "upper({l} || ' ,' || {f})", "array_to_string(regexp_extract_all({f} || {l}, '.'), ' ')")


@query(
    "planted_names",
    f"""WITH n AS (SELECT doc_id, coalesce(text, '') AS text, {_FIRST} AS f, {_LAST} AS l FROM documents),
p AS (SELECT *, CASE doc_id % 5 {' '.join(f"WHEN {k} THEN {form.format(f='f', l='l')}" for k, form in enumerate(_FORMS))} END AS name FROM n)
SELECT doc_id, md5('[PERSON]: ' || left(text, CAST(length(text) // 2 AS BIGINT)) || ' [PERSON] ' || right(text, CAST(length(text) - length(text) // 2 AS BIGINT)) || ' ([PERSON])') AS redacted_md5 FROM p""",
)
def planted_names(spark, d):
    """Every document with a name of its own planted at the beginning, in the middle and at the end, as it is, turned, in capitals or letter by letter; nothing else goes."""
    letters = lambda first: F.concat(F.lit(first), F.translate(F.col("doc_id").cast("string"), "0123456789", "qxwzvkyjfg"), F.lit("q"))
    f, n, k = letters("Qyxz"), letters("Xqzw"), F.col("doc_id") % 5
    forms = (F.concat_ws(" ", f, n), F.concat_ws(", ", n, f), F.concat_ws("\n", n, f), F.upper(F.concat_ws(" ,", n, f)), F.array_join(F.filter(F.split(F.concat(f, n), ""), lambda c: c != ""), " "))
    name = F.when(k == 0, forms[0])
    for j in range(1, 5):
        name = name.when(k == j, forms[j])
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    planted = F.concat(name, F.lit(": "), F.left(text, half), F.lit(" "), name, F.lit(" "), F.right(text, F.length(text) - half), F.lit(" ("), name, F.lit(")"))
    docs = _docs(spark, d).select("doc_id", planted.alias("text"), F.array(F.concat_ws(" ", f, n)).alias("names"))
    return P.redact_entities(docs, "text", "names").select("doc_id", F.md5("redacted").alias("redacted_md5"))


BOILER = "(?i)(licensed under|all rights reserved|license)"


@query("without_boilerplate", f"SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{BOILER}')), chr(10))) AS clean_md5 FROM documents")
def without_boilerplate(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.drop_lines(F.col("text"), BOILER)).alias("clean_md5"))


_SCRUB = ((r"[ \t]+\n", "\n"), (r"!{2,}", "!"), (r"\n{3,}", "\n\n"))


@query("scrubbed", "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+\\n', chr(10), 'g'), '!{2,}', '!', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS clean_md5 FROM documents")
def scrubbed(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.scrub(F.col("text"), _SCRUB)).alias("clean_md5"))


@query("unaccented", f"SELECT doc_id, md5(translate(text, '{T.ACCENTED}', '{T.PLAIN}')) AS plain_md5 FROM documents")
def unaccented(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.unaccent(F.col("text"))).alias("plain_md5"))


@query("redacted_urls", r"SELECT page_id, regexp_replace('see ' || url || ' there', 'https?://[^\s]+', '[URL]', 'g') AS line FROM pages")
def redacted_urls(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.concat(F.lit("see "), "url", F.lit(" there")), r"https?://[^\s]+", "[URL]").alias("line"))


@query("forbidden_tokens", "SELECT conv_id, turn, len(list_filter(['password', 'token', 'the'], lambda t: contains(regexp_replace(lower(coalesce(text, '')), '\\[q[0-9]+\\]', '', 'g'), t)))::BIGINT AS hits FROM conversations")
def forbidden(spark, d):
    masked = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\[q[0-9]+\]", "")
    hits = F.size(F.filter(F.array(*map(F.lit, ("password", "token", "the"))), lambda t: masked.contains(t)))
    return table(spark, d, "conversations").select("conv_id", "turn", hits.cast("long").alias("hits"))


_NOTE = "'Name: ' || c_name || chr(10) || 'geboren am 1.2.19' || (50 + c_custkey % 40) || chr(10) || 'wohnhaft Lange Musterstraße ' || (1 + c_custkey % 90) || ', 12345 Bad Ort' || chr(10) || 'gez. Muster'"


@query("context_redacted", f"SELECT c_custkey, 'Name: [PERSON]' || chr(10) || 'geboren am [GEBURTSDATUM]' || chr(10) || 'wohnhaft Lange [ADRESSE], [PLZ] [ORT]' || chr(10) || 'gez. [PERSON]' AS note FROM customer WHERE length({_NOTE}) > 0")
def context_redacted(spark, d):
    """Labelled personal data in notes made of customers goes by context alone."""
    k = F.col("c_custkey")
    note = F.concat(F.lit("Name: "), "c_name", F.lit("\ngeboren am 1.2.19"), (50 + k % 40).cast("string"), F.lit("\nwohnhaft Lange Musterstraße "), (1 + k % 90).cast("string"), F.lit(", 12345 Bad Ort\ngez. Muster"))
    return table(spark, d, "customer").select("c_custkey", P.redact_context(note).alias("note"))


@query("redacted_spans")
def redacted_spans(spark, d):
    """Personal data as typed places, found in parts of the texts, of overlapping ones the longest, replaced from the right."""
    docs = _docs(spark, d)
    found = S.found(docs, "doc_id", "text", P.RULES)
    one = S.disjoint(S.exclusive_types(found, "doc_id"), "doc_id", [t for t, _, _ in P.RULES])
    out = S.replaced(docs, one, "doc_id", "text", {t: f"[{t.upper()}]" for t, _, _ in P.RULES}, widen=["secret"])
    return out.select("doc_id", F.col("n_spans").alias("spans"), F.md5("redacted").alias("redacted_md5"))
