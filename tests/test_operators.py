"""Golden cases and properties of the library's operators."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomtext.functions import text as T
from loomtext.operators import chunking as C
from loomtext.operators import claims as K
from loomtext.operators import matching as M
from loomtext.operators import privacy as P
from loomtext.operators import redaction as RD
from loomtext.operators import retrieval as R
from loomtext.operators.merge import merge_intervals, snapshot_diff, upsert
from loomtext.sources import documents as D
from loomtext.sources.tables import page_after, scoped, seeded_sample
from loomtext.streaming import jobs as J


def col(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://www.Example.com/a?utm_source=x&b=1&ref=2#top", "https://example.com/a?b=1"),
        ("http://example.com/a?reference=1).", "http://example.com/a"),
        ("example.com/a", "example.com/a"),
        ("", ""),
        (None, ""),
    ],
)
def test_canonical_url(spark, url, want):
    assert col(spark, url, T.canonical_url) == want


def test_url_identity(spark):
    same = ["http://www.example.com:80/a/", "https://EXAMPLE.com:443/a#x", " https://www.example.com/a//"]
    assert {col(spark, u, T.url_identity) for u in same} == {"example.com/a"}
    # path and query tell decisions apart, and a port is only the default of its own scheme
    assert col(spark, "https://a.de/X?Id=A", T.url_identity) == "a.de/X?Id=A"
    assert col(spark, "http://a.de:443/x?", T.url_identity) == "a.de:443/x" and col(spark, "EXAMPLE.com/a", T.url_identity) == "EXAMPLE.com/a" and col(spark, None, T.url_identity) == ""


def test_text_forms(spark):
    assert col(spark, "Auf­trag  ver-\n klagt !", T.hash_form) == "auftrag verklagt !"
    assert col(spark, "Straße Öl", T.fold) == "strasse oel"
    assert col(spark, "Çà é", T.unaccent) == "Ca e"
    assert col(spark, "<p>a &amp; b</p><script>x()</script><!-- c -->", T.visible_text) == "a & b"
    assert col(spark, "keep\nLicensed under X\nend", lambda c: T.drop_lines(c, "(?i)licensed")) == "keep\nend"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab c.\n", max_size=900), st.integers(30, 90))
def test_packing_loses_nothing(text, target):
    squeeze = lambda s: re.sub(r"\s+", "", s)
    for parts in (C.pack(text, target, 2 * target, 10), C.pack_lines(text, target), C.seek_split(text, target)):
        assert squeeze("".join(parts)) == squeeze(text)
    assert all(len(p) <= target for p in C.seek_split(text, target))


def test_pack_golden():
    assert C.pack("aaaa\n\nbbbb\n\ncccc", 10, 20, 0) == ["aaaa\n\nbbbb", "cccc"]
    assert C.pack("aaaa\n\nbbbb\n\ncc", 10, 20, 3) == ["aaaa\n\nbbbb\n\ncc"]
    assert C.pack("word " * 10, 20, 24, 0) == ["word word word word", "word word word word", "word word"]


def test_section_paths():
    assert C.section_paths("intro\n# A\nx\n## B\ny\n# C\n## D\nz") == [("", "intro"), ("A", "x"), ("A > B", "y"), ("C > D", "z")]


def test_pages(spark):
    rows = [(1, "a\fb"), (2, "--- Seite 1 ---\none\n--- Page 2 ---\ntwo"), (3, "plain"), (4, None)]
    got = C.pages(spark.createDataFrame(rows, "k int, t string"), "t").select("k", "page_no", "page_text").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "one\n"), (2, 2, "two"), (3, 1, "plain"), (4, 1, "")]


def test_token_windows_end_with_the_text(spark):
    rows = [(k, " ".join(map(str, range(n)))) for k, n in enumerate((0, 79, 80, 500, 501, 900, 901, 1300))]
    got = C.token_windows(spark.createDataFrame(rows, "k int, t string"), "t")
    found = {(r.k, r.idx): (r.chunk.split()[0], r.n_tokens) for r in got.collect()}
    assert found == {(2, 0): ("0", 80), (3, 0): ("0", 500), (4, 0): ("0", 500), (4, 1): ("400", 101), (5, 0): ("0", 500), (5, 1): ("400", 500), (6, 0): ("0", 500), (6, 1): ("400", 500), (6, 2): ("800", 101), (7, 0): ("0", 500), (7, 1): ("400", 500), (7, 2): ("800", 500)}


def test_merges(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, pos int")
    assert sorted(map(tuple, upsert(now, new, "k", "pos").collect())) == [(1, "a"), (2, "y"), (3, "z")]
    after = spark.createDataFrame([(2, "b"), (3, "c"), (1, None)], "k int, v string")
    assert sorted(map(tuple, snapshot_diff(now, after, "k", "v").collect())) == [(1, "updated"), (2, "unchanged"), (3, "new")]
    iv = spark.createDataFrame([("d", "t", 1, 3), ("d", "t", 4, 5), ("d", "u", 6, 6), ("d", "t", 7, 9), ("d", "t", 20, 21)], "d string, t string, s int, e int")
    got = merge_intervals(iv, ["d"], "t", "s", "e").select("t", "s", "e").collect()
    assert sorted(map(tuple, got)) == [("t", 1, 5), ("t", 7, 9), ("t", 20, 21), ("u", 6, 6)]


def test_scans(spark):
    df = spark.createDataFrame([(k, None if k % 2 else k % 3) for k in range(20)], "k int, owner_id int")
    assert {r.owner_id for r in scoped(df, 1).collect()} == {None, 1} and {r.owner_id for r in scoped(df, None).collect()} == {None}
    assert [r.k for r in page_after(df, "k", 3, 2).collect()] == [4, 5]
    a, b = (sorted(r.k for r in seeded_sample(df.repartition(n), "k", 5, "s").collect()) for n in (1, 7))
    assert a == b and len(a) == 5


def test_retrieval_guards(spark):
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in v.select(R.cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, 0.0, 0.0]
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 2)], "query_id int, id string, rank int")
    fused = R.fuse(a, b, "id").orderBy("rank").collect()
    assert [r.id for r in fused] == ["x", "y"] and fused[0].score == fused[1].score == 1 / 61 + 1 / 62
    hits = a.withColumn("q", F.lit("q")).withColumn("t", F.lit("t"))
    assert [r.rerank_score for r in R.rerank(hits, lambda q, t: 1 / 0, "q", "t").collect()] == [None, None]


def test_aliases(spark):
    alias = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("x", "x")], "alias string, target string")
    assert {r.alias: r.target for r in M.closure(alias).collect()} == {"a": "c", "b": "c", "c": "c", "x": "x"}
    rows = spark.createDataFrame([(1, ["X ", "b", "A", "none"])], "k int, terms array<string>")
    assert M.canonical(rows, M.closure(alias), ["k"], "terms").first().names == ["x", "c"]


def test_redaction():
    assert RD.replace_terms("Herr Max Mustermann, MUSTERMANNS Haus, Max", ["Max Mustermann"], "[P]") == "Herr [P], [P] Haus, Max"
    assert RD.replace_terms("M u s t e r war da", ["Muster"], "[P]") == "[P] war da"
    assert RD.replace_terms("Maximum Max", ["Max"], "[P]") == "Maximum [P]"
    assert RD.replace_terms("Mu5ter", ["Muster"], "[P]") == "[P]"


def test_redaction_stays_linear():
    import time

    began = time.time()
    RD.replace_terms("a " * 50_000, ["a" * 30, "aaaa bbbb"], "[P]")
    assert time.time() - began < 5


def test_recognition(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.de, call 555-123-4567, born 1.2.1990, token: abc"), (2, None)], "k int, t string")
    got = {(r.type, r.value) for r in P.recognise(df, "k", "t").collect()}
    assert {("email", "a.b@c.de"), ("phone", "555-123-4567"), ("birth_date", "1.2.1990"), ("secret", "abc")} <= got
    red = df.select(P.redact(F.col("t"))).first()[0]
    assert red == "mail [EMAIL], call [PHONE], born [DATE], token: abc"


def test_fuzzy_gate(spark):
    claims = spark.createDataFrame([(1, 1, "the quick brown fox jumps")], "d int, c int, claim string")
    pages = spark.createDataFrame([(1, 1, "before the quick brewn fox jumps after"), (1, 2, "nothing of the kind")], "d int, p int, t string")
    assert [r.p for r in K.resembling(claims, pages, "d", "c", "p", "claim", "t").collect()] == [1]


def test_extractors(spark, tmp_path):
    import io
    import zipfile

    (tmp_path / "m.eml").write_text("From: a@b.c\nTo: d@e.f\nSubject: Hi\nContent-Type: text/plain\n\nBody text")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(held.getvalue())
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "w.txt").write_text("====== Head ======\n**bold** [[a:b|Link]] {{media.png}}")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in D.extract(spark, str(tmp_path)).collect()}
    assert got["d.docx"] == ("One\nTwo", None) and got["broken.docx"][0] is None and "BadZipFile" in got["broken.docx"][1]
    assert got["m.eml"][0] == "From: a@b.c\nTo: d@e.f\nSubject: Hi\n\nBody text"
    assert D.clean_markup("====== Head ======\n**bold** [[a:b|Link]] {{media.png}}\n  * item") == "# Head\nbold Link\n- item"
    assert D.clean_markup("<note tip>Mind this</note> {{x.png|A caption}} ((seen)) [[https://a.de/x|Case]] [[ns:some_page#part]]") == "Hinweis: Mind this A caption  (Fn: seen) Case (https://a.de/x) some page"
    assert D.clean_markup("see https://a.de/x and https://b.de/y, //really//") == "see https://a.de/x and https://b.de/y, really"
    assert D.clean_markup("^ A ^ B ^\n| 1 | ::: |\n||\n== low ==") == "A | B\n1\n##### low"
    assert D.html_to_markdown("<h2>§ 1</h2><p>Text <b>x</b></p><ul><li>y</li></ul><script>no</script>") == "## § 1\n\nText x\n\n- y"
    norm = "<norm><metadaten>{}<enbez>{}</enbez><titel>{}</titel></metadaten><textdaten><text><Content><P>{}</P></Content></text></textdaten></norm>"
    law = "<dokumente builddate='20260612'>" + norm.format("<langue>Asylgesetz</langue>", "", "", "x") + norm.format("", "§ 1", "Zweck", "Absatz.") + norm.format("", "Anlage", "Liste", "y") + "</dokumente>"
    assert D.law_xml(law, "AsylG") == ("# Asylgesetz (AsylG)\n\n### § 1 Zweck\n\nAbsatz.", "2026-06-12")
    for bad in ("<!DOCTYPE x [<!ENTITY a 'b'>]>" + law, law.replace("20260612", ""), "<other builddate='20260612'/>"):
        with pytest.raises(ValueError, match="law file"):
            D.law_xml(bad)
    assert D.salvage_json('noise [{"a": 1}, {"b": "x}"}, {"c": ') == [{"a": 1}, {"b": "x}"}]


def test_folds(spark):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("u", k, base + dt.timedelta(seconds=s)) for k, s in enumerate((0, 5, 10, 12, 25))], "u string, id int, ts timestamp")
    assert sorted(r.id for r in J.cooldown(df, "u", "id", "ts", 10).collect()) == [0, 2, 4]
    ops = [("t", 1, "append", "a", "x"), ("t", 2, "append", "a", "x"), ("t", 3, "set", "b", "y"), ("t", 4, "remove", "a", None), ("t", 5, "set", "z", "no")]
    got = J.apply_patches(spark.createDataFrame(ops, "k string, version int, op string, path string, value string"), "k", ["a", "b"]).first()
    assert (got.applied, got.refused, got.state) == (3, 0, '{"a": [], "b": ["y"]}')
    # a version counts once, whatever the order rows come in
    ops = [("t", 2, "set", "b", "late"), ("t", 1, "append", "a", "x"), ("t", 2, "append", "a", "y"), ("t", None, "set", "a", "no"), ("u", 1, "remove", "a", None)]
    got = {r.k: (r.applied, r.refused, r.state) for r in J.apply_patches(spark.createDataFrame(ops, "k string, version int, op string, path string, value string"), "k", ["a", "b"]).collect()}
    assert got == {"t": (2, 2, '{"a": ["x", "y"], "b": []}'), "u": (0, 0, '{"a": [], "b": []}')}


def test_stream_of_tickets(spark, tmp_path):
    rows = [("a", "issue", 1000.0), ("a", "redeem", 1005.0), ("a", "redeem", 1006.0), ("b", "issue", 1000.0), ("b", "redeem", 1099.0), ("c", "redeem", 1001.0)]
    schema = "ticket string, kind string, ts double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", "1 second")
        out = stream.groupBy("ticket").applyInPandasWithState(J.Tickets(30), J.Tickets.output, J.Tickets.state, "append", "EventTimeTimeout")
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())), q.lastProgress

    want = [("a", 1005.0, True), ("a", 1006.0, False), ("b", 1099.0, False), ("c", 1001.0, False)]
    assert run()[0] == want
    # a ticket that nobody redeems is gone from the state once the watermark is past it
    for part in ([("d", "issue", 1100.0)], [("e", "issue", 1500.0)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        found, progress = run()
    assert found == want and progress.stateOperators[0].numRowsTotal == 1


def test_stream_merges_latest(spark, tmp_path):
    rng = random.Random(0)
    schema = "k int, v string, pos int"
    for part in range(3):
        spark.createDataFrame([(rng.randint(0, 5), f"{part}-{n}", part * 100 + n) for n in range(10)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    every = spark.read.schema(schema).parquet(f"{tmp_path}/in")
    want = {r.k: r.v for r in every.orderBy("pos").collect()}
    stream = spark.readStream

    def run():
        J.latest_wins(spark, stream.option("maxFilesPerTrigger", 4).schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/t", "k", "pos", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    run()
    now = J.current(spark, f"{tmp_path}/t")
    assert {r.k: r.v for r in now.collect()} == want and now.columns == ["k", "v"]
    # later files, one of them late: an older position does not win over what the table holds
    spark.createDataFrame([(1, "late", 0), (2, "new", 999), (77, "first", 1)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert {r.k: r.v for r in J.current(spark, f"{tmp_path}/t").collect()} == want | {2: "new", 77: "first"}


def test_registered_queries():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) >= 100


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_character_references(spark):
    import html

    texts = ["M&uuml;ller &sect; 3 &#8211; x", "&amp;auml; &#38;lt; &AMP;", "&copy 2020 &notit; &nosuch; & &;", "&#x1F600;&#128;&#0;&#xD800;&#9999999;", "&NotEqualTilde; &ampx &amp", "plain", "", "&lt;&gt;&quot;&#39;&nbsp;x"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, x string").select(F.col("k"), T.unescape(F.col("x")).alias("y")).orderBy("k").select("y").collect()]
    # a reference to no-break space becomes a plain one
    assert got == [html.unescape(t).replace("\xa0", " ") if "nbsp" in t else html.unescape(t) for t in texts]
    assert col(spark, "<p>M&uuml;ller &sect;&nbsp;3</p>", T.visible_text) == "Müller § 3" and col(spark, None, T.visible_text) is None


def test_query_encoding(spark):
    same = {col(spark, u, T.canonical_url) for u in ("https://a.de/x?q=%C3%A4+b", "https://a.de/x?q=ä%20b&utm_x=1", "https://A.de/x?q=ä b")}
    assert same == {"https://a.de/x?q=%C3%A4+b"}
    assert col(spark, "https://a.de/x?empty&z=1%2B1&bad=%zz&t=~*", T.canonical_url) == "https://a.de/x?empty=&z=1%2B1&bad=%25zz&t=~%2A"


def test_pages_scopes_and_titles(spark):
    from loomtext.operators.merge import untold
    from loomtext.sources.tables import export_page, in_scope

    df = spark.createDataFrame([(k, "firm" if k == 3 else "user", k % 2) for k in range(5)] + [(9, None, None)], "k int, scope string, owner_id int")
    assert [(r.k, r.next_cursor) for r in export_page(df.select("k"), "k", 0, 2).collect()] == [(1, 2), (2, 2)]
    assert [(r.k, r.next_cursor) for r in export_page(df.select("k"), "k", 3, 5).collect()] == [(4, None), (9, None)] and export_page(df.select("k"), "k", 9, 2).collect() == []
    assert sorted(r.k for r in in_scope(df, 0).collect()) == [0, 2, 3, 4] and [r.k for r in in_scope(df, None).collect()] == [3]
    proposed = spark.createDataFrame([(1, " ALPHA "), (1, "beta"), (2, "alpha"), (1, None)], "c int, title string")
    entries, sources = spark.createDataFrame([(10, "Alpha"), (11, None)], "e int, title string"), spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "c int, e int")
    assert sorted(((r.c, r.title) for r in untold(proposed, entries, sources, "c", "e", "title").collect()), key=repr) == [(1, "beta"), (1, None), (2, "alpha")]
