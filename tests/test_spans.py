"""Spans: found in parts of long texts, without overlaps, widened and replaced."""

import random
import re
import time

import pytest

from loomtext.operators import spans as S

RULES = (("number", r"(?<!\d)\d{3,8}(?!\d)", 0.5), ("mail", r"\b[a-z]+@[a-z]+\.de\b", 0.9), ("name", r"Herrn? ([A-Z][a-z]+)", 0.8))


def plain(text):
    return sorted((t, *m.span(1 if re.compile(p).groups else 0)) for t, p, _ in RULES for m in re.finditer(p, text))


@pytest.mark.parametrize("size", [31, 60, 10_000])
def test_result_does_not_depend_on_the_cut(spark, size):
    draw = random.Random(9)
    words = ["Herr Maier", "Herrn Ott", "12", "1234567", "99999", "ab@cd.de", "x@y.de.", "wort", "\n", "ä", "𝄞", "Herr"]
    texts = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(0, 60)))) for k in range(25)] + [(99, ""), (100, None)]
    got = S.found(spark.createDataFrame(texts, "k int, t string"), "k", "t", RULES, size=size, margin=30)
    held = {}
    for r in got.collect():
        held.setdefault(r.k, []).append((r.type, r.start, r.end))
        assert dict(texts)[r.k][r.start : r.end] == r.value
    assert {k: sorted(v) for k, v in held.items()} == {k: plain(t) for k, t in texts if t and plain(t)}


def test_parts_cover_a_text_once(spark):
    with pytest.raises(ValueError):
        S.text_parts(spark.createDataFrame([(1, "x")], "k int, t string"), "k", "t", 10, 11)
    text = "".join(chr(97 + k % 26) for k in range(103))
    parts = S.text_parts(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", 10, 4).orderBy("at").collect()
    assert "".join(p.part[p.core : p.core + p.width] for p in parts) == text
    assert all(text[p.at : p.at + len(p.part)] == p.part for p in parts) and len(parts) == 11


def plain_disjoint(spans, types):
    rank = {t: k for k, t in enumerate(types)}
    kept = []
    for s in sorted(set(spans), key=lambda s: (s[0] - s[1], rank.get(s[2], len(types)), s[0], s[2])):
        if all(s[1] <= a or b <= s[0] for a, b, _ in kept):
            kept.append(s)
    return sorted(kept)


def test_no_kept_span_overlaps(spark):
    draw = random.Random(2)
    spans = [(k, a, a + draw.randint(0, 9), draw.choice("xyz")) for k in range(40) for a in [draw.randrange(40) for _ in range(draw.randint(1, 25))]]
    frame = spark.createDataFrame(spans, "k int, start long, end long, type string").repartition(4)
    held = {}
    for r in S.disjoint(frame, "k", ["y", "x"]).collect():
        held.setdefault(r.k, []).append((r.start, r.end, r.type))
    assert {k: sorted(v) for k, v in held.items()} == {k: w for k in range(40) if (w := plain_disjoint([(a, b, t) for q, a, b, t in spans if q == k and b > a], ["y", "x"]))}


def test_replacement_from_the_right(spark):
    texts = [(1, "Herr Maier-Ott wohnt in Essen, Maiers Haus."), (2, "nichts"), (3, None), (4, "ab cd")]
    spans = [(1, 5, 10, "name"), (1, 24, 29, "place"), (1, 31, 36, "name"), (1, 90, 99, "name"), (1, 0, 4, "other"), (4, 0, 2, "place"), (4, 1, 5, "place"), (9, 0, 1, "name")]
    out = S.replaced(spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(spans, "k int, start long, end long, type string"), "k", "t", {"name": "[P]", "place": "[O]"}, widen=["name"])
    got = {r.k: (r.redacted, r.n_spans) for r in out.collect()}
    assert got == {1: ("Herr [P] wohnt in [O], [P] Haus.", 3), 2: ("nichts", 0), 3: (None, 0), 4: ("[O]", 1)}


def test_types_exclude_each_other(spark):
    spans = [(1, "A-1", "file", 0.8), (1, "a1", "number", 0.5), (1, "b", "number", 0.5), (2, "a1", "number", 0.5), (1, "c", "x", 0.7), (1, "C", "y", 0.7)]
    got = S.exclusive_types(spark.createDataFrame(spans, "k int, value string, type string, score double"), "k").collect()
    assert sorted((r.k, r.value, r.type) for r in got) == [(1, "A-1", "file"), (1, "b", "number"), (1, "c", "x"), (2, "a1", "number")]


def test_a_long_text_is_many_rows(spark):
    began = time.time()
    frame = spark.createDataFrame([(1, "Herr Maier hat 1234 ab@cd.de. " * 400_000)], "k int, t string")  # 12 MB
    parts = S.text_parts(frame, "k", "t")
    assert parts.count() == 120
    counts = {r.type: r["count"] for r in S.found(frame, "k", "t", RULES).groupBy("type").count().collect()}
    assert counts == {"name": 400_000, "number": 400_000, "mail": 400_000} and time.time() - began < 90
