"""Packing, proposals, web search and entities on small cases."""

import json
import re

import pytest

from loomtext.operators import chunking as C
from loomtext.operators import memory as M
from loomtext.operators import privacy as A
from loomtext.operators import retrieval as R

LISTS, SCALARS = ["facts"], ["title"]


def test_long_lines_and_pages_are_cut():
    assert C.pack_lines("a" * 50 + "\nbb\ncc", 10, 20) == ["a" * 20, "a" * 20, "a" * 10, "bb\ncc"]
    assert C.pack_lines("") == [""] and C.pack_lines("x\n\n") == ["x"]
    text = "--- Seite 1 ---\none\n\n--- Seite 2 ---\ntwo\n\n--- Seite 3 ---\n" + "z" * 60
    parts = C.pack_pages(text, 45)
    assert parts[0].startswith("--- Seite 1 ---") and "--- Seite 2 ---" in parts[0] and all(len(p) <= 45 for p in parts)
    assert re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", text)
    assert C.pack_pages("short", 45) == ["short"] and C.pack_pages("aaaa\n\nbbbb\n\n" + "c" * 12, 12) == ["aaaa\n\nbbbb", "c" * 12]


def test_section_title_leads():
    assert C.section_paths("lead\n# Page\nx\n## Sub\ny", "page") == [("page", "lead"), ("Page", "x"), ("Page > Sub", "y")]
    assert C.section_paths("# A\nx", "T") == [("T > A", "x")]


def test_operations():
    now = {"facts": ["a", "b"], "title": "t"}
    op = lambda kind, path, value=None: {"op": kind, "path": path, "value": value}
    assert M.apply_op(now, op("append", "/facts/-", "c"), LISTS, SCALARS)["facts"] == ["a", "b", "c"] and now["facts"] == ["a", "b"]
    assert M.apply_op(now, op("set", "/facts/1", "x"), LISTS, SCALARS)["facts"] == ["a", "x"]
    assert M.apply_op(now, op("remove", "/facts/0"), LISTS, SCALARS)["facts"] == ["b"]
    for bad in (op("append", "/title", 1), op("set", "/other", 1), op("remove", "/facts/7"), op("remove", "/facts"), op("set", "/facts/0/x", 1), op("move", "/facts", 1), op("append", "", 1)):
        with pytest.raises(M.Refused):
            M.apply_op(now, bad, LISTS, SCALARS)


def test_rebase():
    now = {"facts": ["A fact", "b"], "title": "new"}
    ops = [
        {"op": "append", "path": "/facts", "value": "a  FACT"},  # is there
        {"op": "append", "path": "/facts", "value": "more"},
        {"op": "set", "path": "/title", "value": "New"},  # is so
        {"op": "set", "path": "/facts", "value": ["only this"]},  # would undo what has just changed
        {"op": "remove", "path": "/facts/9"},  # no longer applies
    ]
    assert M.rebase(ops, now, {"facts"}, LISTS, SCALARS) == ops[1:2]
    assert M.changed({"facts": ["a"], "title": "x"}, {"facts": ["a"], "title": "X ", "more": 1}) == {"more"}


def test_settle(spark):
    targets = spark.createDataFrame([("d", 3, json.dumps({"facts": []}))], "k string, version long, content string")
    ops = lambda *values: json.dumps([{"op": "append", "path": "/facts", "value": v} for v in values])
    queue = [("d", 1, 2, ops("stale")), ("d", 2, 3, ops()), ("d", 3, 3, ops("x")), ("d", 4, 3, ops("x")), ("d", 5, 3, ops("x", "y"))]
    got = {r.id: r for r in M.settle(targets, spark.createDataFrame(queue, "k string, id long, expected long, ops string"), "k", LISTS, SCALARS).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "mismatch", 2: "refused", 3: "accepted", 4: "superseded", 5: "pending"}
    assert json.loads(got[3].content) == {"facts": ["x"]} and got[3].version == 4 and json.loads(got[5].ops) == json.loads(ops("y"))


def test_web_queries(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "brown quick dog"), (3, "quick brown dog"), (4, None)], "id long, text string")
    want = {'"quick brown" -dog': [1], "quick or fox": [1, 2, 3], "brown -fox": [2, 3], "quick-brown": [1, 3], "-dog": [], "cat OR dog": [2, 3], "": [], "brown brown": [1, 2, 3]}
    asked = spark.createDataFrame(list(enumerate(want)), "q long, said string")
    got = R.web_matches(docs, R.parse_queries(asked, "q", "said"), "id", "text").collect()
    assert {q: sorted(r.id for r in got if r.query_id == k) for k, q in enumerate(want)} == want


def test_retrieve(spark):
    docs = spark.createDataFrame([(k, f"word{k} common text") for k in range(6)], "id long, text string")
    vectors = spark.createDataFrame([(k, [1.0, k / 10]) for k in range(6)], "id long, v array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0], "word5")], "query_id long, query array<double>, query_text string")
    got = R.retrieve(docs, vectors, asked, "id", "text", "v", limit=3, dense_k=3).orderBy("place").collect()
    assert [r.id for r in got] == [0, 5, 1]  # first of each list, the dense one before
    got = R.retrieve(docs, vectors, asked, "id", "text", "v", limit=2, dense_k=3, scorer=lambda q, t: [float(x[4]) for x in t]).orderBy("place").collect()
    assert [(r.id, r.score) for r in got] == [(5, 5.0), (2, 2.0)]


def test_profile_entities(spark):
    text = "Az.: 3 K 12/21; Urteil vom 1.2.2020, Az. 9 K 99/19. geb. am 3.4.1990. am 5.6.2021. Ausweis-Nr. ZX1234"
    got = {(r.type, r.value) for r in A.case_entities(spark.createDataFrame([(1, text), (2, None)], "k long, t string"), "k", "t").collect()}
    assert {("court_file", "3 K 12/21"), ("birth_date", "3.4.1990"), ("document_id", "ZX1234")} <= got
    assert not any(v in ("9 K 99/19", "5.6.2021") for _, v in got)
