"""Stems, cover density, links of pages and what they reach."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.operators import lexical as L
from loomtext.operators import retrieval as R
from loomtext.sources import links as S


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("aufeinander", "aufeinand"), ("kategorien", "kategori"), ("häuser", "haus"), ("laufen", "lauf"), ("bedingungen", "beding"), ("ergebnisse", "ergebnis"), ("verfolgung", "verfolg"),
        ("verfolgungen", "verfolg"), ("glaubhaftigkeit", "glaubhaft"), ("freundlichkeit", "freundlich"), ("straße", "strass"), ("kräftigsten", "kraftig"), ("am", "am"), ("", ""), ("bauer", "bau"), ("weiblich", "weiblich"), ("jugendlich", "jugend"),
    ],
)
def test_stems(word, stem):
    assert L.german_stem(word) == stem


def plain_covers(branches):
    """All stretches between places that hold a branch, without those that hold another."""
    places = sorted({int(p) for b in branches for t in b for p in t})
    full = [(a, b) for a in places for b in places if a <= b and any(len(br) and all(any(a <= x <= b for x in t) for t in br) for br in branches)]
    least = [(a, b) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)]
    return [(a, b, sum(a <= p <= b for p in places)) for a, b in least]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.lists(st.integers(0, 25), min_size=0, max_size=5), min_size=1, max_size=3), min_size=1, max_size=2))
def test_covers_equal_trying_all(branches):
    arrays = [[np.array(sorted(set(t)), np.int64) for t in b] for b in branches]
    assert L.covers(arrays) == plain_covers(branches)


def test_rank_prefers_dense_covers(spark):
    docs = spark.createDataFrame([(1, "rote Häuser am Fluss"), (2, "rote alte große Häuser"), (3, "rotes Haus, rotes Haus"), (4, "rot"), (5, None), (6, "Häuser rote nicht blau")], "k int, t string")
    asked = spark.createDataFrame([("q", "rote häuser -blau")], "query_id string, q string")
    plain = {r.k: r.score for r in R.cover_search(docs, asked, "k", "t", "q", 10).collect()}
    assert plain == {1: 0.1, 2: pytest.approx(0.033333)}
    stemmed = R.cover_search(docs, asked, "k", "t", "q", 10, L.stemmed_terms).orderBy("rank").collect()
    assert [(r.k, r.score) for r in stemmed][:2] == [(3, pytest.approx(0.3)), (1, 0.1)]


@pytest.mark.parametrize(
    ("href", "page"),
    [
        ("/wiki/a:b", "wiki/a:b"), ("a:b", None), ("x/y", "x/y"), ("https://site.test/start", "start"), ("//site.test/x", "x"), ("https://other.test/start", None), ("/_export/raw/p:q", "p:q"), ("/_export/xhtml/p", "p"),
        ("/?id=n:m&do=index", "n:m"), ("/x?do=edit", None), ("/x?do=index", "x"), ("/lib/tpl.css", None), ("/pic.png", None), ("/_media/x", None), ("mailto:a@b.c", None), ("#top", None), ("/x#part", "x"), ("/a/../b", None),
        ("/M%C3%BCller/", "Müller"), ("", None), (None, None), ("javascript:void(0)", None), ("/50%", "50%"),
    ],
)
def test_page_ids(spark, href, page):
    assert spark.createDataFrame([(href,)], "h string").select(S.page_id(F.col("h"), "https://site.test/")).first()[0] == page


def test_hrefs(spark):
    html = """<a href="/a">x</a><A class=q HREF='/b?x=1&amp;y=2'>y</A><link href="/no.css"><a name=z>z</a><a href=/c>w</a>"""
    assert spark.createDataFrame([(html,), (None,)], "h string").select(S.hrefs(F.col("h"))).collect()[0][0] == ["/a", "/b?x=1&y=2", "/c"]


def test_discovery_equals_a_queue(spark):
    draw = random.Random(5)
    name = lambda k: f"{'skip' if k % 7 == 0 else 'ns'}:{k}"
    edges = [(name(draw.randrange(60)), name(draw.randrange(60))) for _ in range(90)] + [(name(1), None), (name(1), name(1))] + [(name(k), name(2)) for k in range(60)]
    for depth in (0, 1, 3, 50):
        seen, frontier = {name(1): 0, name(3): 0}, [name(1), name(3)]
        for step in range(1, depth + 1):
            frontier = sorted({b for a, b in edges if a in frontier and b and b not in seen and not b.startswith("skip:")})
            seen |= dict.fromkeys(frontier, step)
        links = spark.createDataFrame(edges, "a string, b string")
        got = S.discovered(links, spark.createDataFrame([(name(1),), (name(3),), (None,), (name(7),)], "page string"), "a", "b", depth, ["skip"])
        assert {r.page: r.depth for r in got.collect()} == seen


def test_texts_do_not_leave_their_place_to_be_searched(spark):
    from loomtext.operators import retrieval as R

    docs = spark.createDataFrame([(1, "a b a c"), (2, None), (3, "b c d")], "k long, t string")
    asked = spark.createDataFrame([(1, '"b a" OR d'), (2, "c -d")], "query_id long, q string")
    index = R.postings(docs, "k", "t")
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.k, r.term, r.tf, r.length, r.at) for r in index.collect()) == [(1, "a", 2, 4, [0, 2]), (1, "b", 1, 4, [1]), (1, "c", 1, 4, [3]), (3, "b", 1, 3, [0]), (3, "c", 1, 3, [1]), (3, "d", 1, 3, [2])]
    found = R._matches(docs, R.parse_queries(asked, "query_id", "q"), "k", "t", R.terms_of, False, sent=100)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.query_id, r.k) for r in found.collect()) == [(1, 1), (1, 3), (2, 1)]
