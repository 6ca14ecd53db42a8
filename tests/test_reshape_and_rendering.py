"""Flat answers reshaped, and sectioned blocks under a budget."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import rendering as D
from loomtext.operators import reshape as S


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('{"alter": 30, "themen": ["a"], "geschlecht": "m"}', '{"themen":["a"],"profil":{"alter":30,"geschlecht":"m"}}'),
        ('{"alter": null, "gesundheit": "", "besonderheiten": [], "x": {}, "y": false, "z": 0}', '{"y":false,"z":0}'),
        ('{"netzwerk_im_herkunftsland": false}', '{"profil":{"netzwerk_im_herkunftsland":false}}'),
        ("[1, 2]", "{}"), ("not json", "{}"), ("", "{}"), (None, "{}"), ('{"a": 1.50, "b": {"c": null}}', '{"a":1.5,"b":{"c":null}}'),
    ],
)
def test_nested(spark, answer, want):
    assert one(spark, answer, S.nested) == want


def test_roles_and_classes(spark):
    answer = '{"reliance_alter": " Traegt ", "reliance_geschlecht": "sehr", "reliance_gesundheit": null, "reliance_familienstand": 7, "reliance_netzwerk_im_herkunftsland": "irrelevant"}'
    assert one(spark, answer, S.roles) == {"alter": "traegt", "netzwerk_im_herkunftsland": "irrelevant"}
    assert one(spark, answer, S.unknown_roles) == ["geschlecht", "familienstand"]
    assert one(spark, None, S.roles) == {} and one(spark, "[]", S.unknown_roles) == []
    kinds = {"bescheid": "Bescheid", "urteil": "Rechtsprechung"}
    got = lambda x: tuple(one(spark, x, lambda c: S.classification(c, kinds)))
    assert got('{"category": " Urteil", "confidence": 1.7, "explanation": " x "}') == ("Rechtsprechung", 1.0, "x", None)
    assert got('{"category": "bescheid", "confidence": "none"}') == ("Bescheid", 0.0, "", None)
    assert got('{"category": "brief", "confidence": 0.5}') == (None, None, None, "unknown category: brief")
    assert got("nothing") == (None, None, None, "no valid JSON") and got(None)[3] == "no valid JSON"


def plain_block(entries, budget, headings):
    """Sections in order, each text that fits what is left with its heading."""
    parts, left, n = [], budget, 0
    for k, title in enumerate(headings):
        here = []
        for text in (t for s, _, t in sorted(entries, key=lambda e: (e[0], e[1])) if s == k):
            if len(text) + len(title) <= left:
                here.append(text)
                left -= len(text)
                n += 1
        if here:
            parts.append("\n\n".join([title, *here]))
            left -= len(title)
    return "\n\n".join(parts), n


def test_blocks_equal_the_plain_version(spark):
    draw = random.Random(4)
    rows = [(c, draw.randrange(3), k, "x" * draw.randint(1, 120)) for c in range(30) for k in range(draw.randint(1, 12))]
    for budget in (10, 90, 200, 5000):
        got = D.sectioned(spark.createDataFrame([*rows, (1, 7, 0, "no such section"), (1, 0, 0, None)], "c int, s int, k int, t string"), "c", "s", [F.col("k")], "t", budget=budget)
        want = {c: plain_block([(s, k, t) for d, s, k, t in rows if d == c], budget, D.HEADINGS) for c in {r[0] for r in rows}}
        assert {r.c: (r.block, r.entries) for r in got.collect()} == want


def test_sections_and_notes(spark):
    rows = [("pro", "niedrig", False), ("pro", "ungeprueft", None), ("pro", "niedrig", True), ("pro", "hoch", False), ("gegen", "niedrig", False), ("neutral", None, False), (None, None, None)]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, c string, r string, s boolean").orderBy("k").select(D.decision_section(F.col("c"), F.col("r"), F.col("s")).alias("y")).collect()
    assert [r.y for r in got] == [0, 0, 1, 1, 2, 1, 1]
    notes = [("gegen", "hoch", ["alter"], None), ("gegen", "hoch", None, None), ("pro", "hoch", ["alter", "netzwerk_im_herkunftsland"], ["geschlecht"]), ("neutral", "niedrig", None, None), ("pro", "moeglich", [], ["sprache"]), ("pro", "niedrig", None, None)]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(notes)], "k int, c string, r string, a array<string>, d array<string>").orderBy("k").select(D.risk_note(*map(F.col, "crad")).alias("y")).collect()
    assert [r.y for r in got] == ["- Unterscheidbar: dort abweichend — Alter", "", "- RISIKO: leicht zu unterscheiden — Entscheidung trägt auf: Alter, Netzwerk im Herkunftsland", "- Hinweis: Ergebnis unklar/ungeprüft — nicht ungeprüft zitieren", "- Hinweis: Profil weicht ab (sprache)", ""]
