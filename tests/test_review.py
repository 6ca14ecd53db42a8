"""Gates, letters, sources of a case, new operations and reports on small tables with nulls, ties and empty texts."""

from __future__ import annotations

import csv
import glob
import json

from pyspark.sql import functions as F

from loomtext.operators import gates as G
from loomtext.operators import identity as I
from loomtext.operators import inventory as V
from loomtext.operators import memory as M
from loomtext.operators import privacy as A
from loomtext.operators import ranking as K
from loomtext.operators import residue as Z
from loomtext.sources import sinks as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_gates_of_missing_values(spark):
    none = F.lit(None).cast("string")
    assert one(spark, G.may_segment(F.lit(None).cast("int"), none)) is False
    assert one(spark, G.may_segment(F.lit(2), none)) is True
    assert one(spark, G.may_read(none)) is True
    assert one(spark, G.must_anonymise(none, F.lit("letter"))) is False
    assert one(spark, G.named_notes(none, F.array(F.lit("a"), none))) == []
    assert one(spark, G.names_notes(F.lit("keine Notizen"))) is False
    assert one(spark, G.named_notes(F.lit("siehe b.pdf"), F.array(F.lit(" b.pdf "), F.lit(""), F.lit("c.pdf")))) == ["b.pdf"]
    assert one(spark, G.plausible_law(F.lit("X"), none)) is False


def test_plausible_law_needs_every_anchor(spark):
    body = "".join(f"## § {i}\n" for i in range(1, 80))
    assert one(spark, G.plausible_law(F.lit("AsylG"), F.lit(body))) is True
    assert one(spark, G.plausible_law(F.lit("AsylG"), F.lit(body.replace("§ 77\n", "§ 770\n")))) is False
    assert one(spark, G.plausible_law(F.lit("AufenthG"), F.lit(body))) is False


def test_letters_keep_prose(spark):
    text = "Frau X ./. Land\r\nDer Kläger trägt vor, die Bundesrepublik sei zuständig.\r\ngegen\r\n[PERSON], [ORT].\r\n[PERSON] [ORT] ."
    assert one(spark, Z.clean_redacted(F.lit(text))) == "Der Kläger trägt vor, die Bundesrepublik sei zuständig.\n[PERSON], [ORT]."
    long = "Die Kanzlei Muster " + "und noch ein Wort " * 4
    assert one(spark, Z.without_letterhead(F.lit(f"Kanzlei Muster\n{long}"), (), "Kanzlei Muster")) == long
    assert one(spark, Z.without_letterhead(F.lit(None).cast("string"), ())) == ""
    assert one(spark, Z.scrub_residue(F.lit("am 123/20 und 1234/20"))) == "am [AKTENZEICHEN] und 1234/20"


def test_file_numbers_compared(spark):
    for a, b in (("VG Köln 1 K 2/20", "köln1k2/20"), ("BVerwG 1 C 5.09", "1c5.09"), ("C‑163/17 [Jawo]", "c-163/17"), ("4 LB 20/19 OVG", "4lb20/19"), (None, "")):
        assert one(spark, I.number_compared(F.lit(a).cast("string"))) == b


def test_citations_resolve_to_one_document(spark):
    inventory = spark.createDataFrame(
        [(1, 10, "B1", "Bescheid vom Mai", "bescheid", "primary", 1, 9, [1, 2]), (1, 11, "A1", "Akte", "akte", None, 10, 90, [10, 11]), (1, 12, None, "", "akte", None, None, None, None), (2, 20, "Z", None, None, None, None, None, None)],
        "case int, item int, source_key string, label string, category string, role string, page_start int, page_end int, pages array<int>",
    )
    cited = spark.createDataFrame(
        [(1, 0, "A1", "Anlage K 2", "", [3]), (1, 1, "none", "anlage k2", "", []), (1, 2, None, "Bl. 12", None, [12]), (1, 3, None, "Bl. 95", None, [95]), (1, 4, None, "", "Bescheid vom  Mai!", None), (2, 0, None, None, None, None), (3, 0, "A1", "Bl. 1", "", [1])],
        "case int, n int, source_key string, citation string, hint string, pages array<int>",
    )
    got = {(r.case, r.n): (r.item, r.rule) for r in V.resolve(cited, inventory, "case", ["n"]).collect()}
    assert got == {(1, 0): (11, "key"), (1, 1): (10, "exhibit"), (1, 2): (11, "sheet"), (1, 3): (None, None), (1, 4): (10, "label"), (2, 0): (20, "only"), (3, 0): (None, None)}


def test_links_and_titles(spark):
    text = "Vorwort. [Ein Urteil](https://a.de/x?y=1) dazu https://a.de/x?y=1 und. Kurz: http://b.de"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    assert [tuple(r) for r in V.links_with_titles(df, "k", "t").orderBy("k", "n").collect()] == [(1, 0, "https://a.de/x?y=1", "Ein Urteil"), (1, 1, "http://b.de", "http://b.de")]


def test_files_of_a_case(spark):
    found = spark.createDataFrame([(1, "a/Brief.PDF"), (2, "a/Brief.PDF"), (1, "x/.hidden"), (1, "a.b.odt"), (1, None)], "case int, path string")
    known = spark.createDataFrame([(1, "z/brief.odt"), (1, "a.b.pdf")], "case int, path string")
    assert sorted((r.case, r.path or "") for r in V.not_in_case(found, known, "case", "path").collect()) == [(1, ""), (1, "x/.hidden"), (2, "a/Brief.PDF")]


def test_new_operations_against_a_plain_loop(spark):
    import random

    rng = random.Random(5)
    ops = [(t, i, rng.choice(["append", "set", "remove"]), rng.choice("fg"), rng.choice(["A", "a ", "B", "", None, "c  d"])) for t in range(20) for i in range(15)]
    current = [(t, "f", v) for t in range(0, 20, 2) for v in ("a", "x")] + [(t, "g", "") for t in range(20)]
    pending = [(t, "g", "C d") for t in range(0, 20, 3)]
    norm = lambda v: " ".join((v or "").split()).lower()
    for protect in (False, True):
        want = []
        for t in range(20):
            have, waiting = {}, {(f, norm(v)) for k, f, v in pending if k == t}
            for k, f, v in current:
                have.setdefault(f, set()).add(norm(v)) if k == t else None
            kept, count = [], {}
            for _, i, op, f, v in [o for o in ops if o[0] == t]:
                n = norm(v)
                if op == "append" and (not n or n in have.get(f, ()) or (f, n) in waiting):
                    continue
                if op == "set" and (n in (have.get(f) or {""}) or (f, n) in waiting or protect and any(have.get(f, ()))):
                    continue
                if op != "remove":
                    waiting.add((f, n))
                kept.append((t, i, op, f))
            total = 0
            for row in kept:
                if row[2] == "append":
                    count[row[3]] = count.get(row[3], 0) + 1
                    if count[row[3]] > 3:
                        continue
                if total < 8:
                    want.append(row[:2])
                    total += 1
        make = lambda rows: spark.createDataFrame(rows, "t int, field string, value string")
        got = M.new_ops(spark.createDataFrame(ops, "t int, i int, op string, field string, value string"), make(current), make(pending), "t", "i", protect)
        assert sorted((r.t, r.i) for r in got.collect()) == sorted(want)


def test_engines_merge_and_score(spark):
    a = spark.createDataFrame([("http://A.de/x", 1), ("http://a.de/x#f", 0), ("", 3)], "url string, n int")
    b = spark.createDataFrame([("http://www.a.de/x", 0), ("http://b.de", 1)], "url string, n int")
    assert sorted(tuple(r) for r in K.merge_engines([a, b], "url", "n").select("url", "n", "engine", "engines").collect()) == [("http://a.de/x#f", 0, 0, 2), ("http://b.de", 1, 1, 1)]
    assert one(spark, K.engine_score(F.lit("x.PDF"), F.lit("urteil 2020"), K.Scorer(each=((("urteil", "az"), 5),), unless=((("az",), -3),), pdf=6, since=2014, per_year=2), 2026)) == 20


def test_report_files(spark, tmp_path):
    rows = [("a;b", "pdf", "IN", ["x", "y"], None), ("c", "pdf", "OUT", [], 0.5), ("d", None, "IN", ["x"], 1.0)]
    df = spark.createDataFrame(rows, "path string, extension string, decision string, reasons array<string>, confidence double")
    for _ in range(2):  # a second run replaces the first
        out = S.write_report(df, str(tmp_path), "r1", "decision", "extension", "reasons")
    back = [r for f in glob.glob(out["csv"] + "/*.csv") for r in csv.DictReader(open(f))]
    assert sorted((r["path"], r["reasons"], r["confidence"]) for r in back) == [("a;b", "x;y", ""), ("c", "", "0.5"), ("d", "x", "1.0")]
    lines = [json.loads(x) for f in glob.glob(out["jsonl"] + "/*.json") for x in open(f)]
    assert len(lines) == 3 and all("confidence" in x for x in lines)
    got = {(r.part, r.name, r.decision): r.n for r in spark.read.json(out["summary"]).collect()}
    assert got == {("total", None, None): 3, ("decision", None, "IN"): 2, ("decision", None, "OUT"): 1, ("extension", "pdf", "IN"): 1, ("extension", "pdf", "OUT"): 1, ("extension", None, "IN"): 1, ("reason", "x", None): 2, ("reason", "y", None): 1}
    empty = S.summary(df.limit(0), "decision", "extension", "reasons").collect()
    assert [(r.part, r.n) for r in empty] in ([], [("total", 0)])


def test_names_beside_marks(spark):
    names = lambda text, *known: one(spark, A.marked_names(F.lit(text).cast("string"), F.array(*map(F.lit, known)).cast("array<string>") if known else F.lit(None).cast("array<string>")))
    assert names(None) == [] and names("") == []
    assert names("IM AUFTRAG: Dora Özgür O'Neill\nSachbearbeiterin Anna Muster") == ["Dora Özgür O'Neill", "Anna Muster"]
    assert names("gez. Anna Muster und gez. ANNA MUSTER", "anna muster ") == []
    assert names("Nachname - Omar\nName: Landgericht Köln\nName: 12 Uhr\nName: Omar") == ["Omar"]
