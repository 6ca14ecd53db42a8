"""Names, places and numbers in scanned text: cases, a plain version with regular expressions, and long texts."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.operators import redaction as R


@pytest.mark.parametrize(
    ("text", "terms", "kind", "want"),
    [
        ("Die Polizei war politisch motiviert, die Liste liegt vor.", ["Li"], "person", "Die Polizei war politisch motiviert, die Liste liegt vor."),
        ("Besprechung mit Herrn Li heute.", ["Li"], "person", "Besprechung mit Herrn [X] heute."),
        ("Lis Antrag ging ein.", ["Li"], "person", "[X] Antrag ging ein."),
        ("Termin mit HerrMüller, Müllerstraße 4.", ["Müller"], "person", "Termin mit Herr[X], [X]straße 4."),
        ("Geboren am 19.11.1997.", ["Li"], "person", "Geboren am 19.11.1997."),
        ("Frau Schm1tt erschien.", ["Schmitt"], "person", "Frau [X] erschien."),
        ("Herr Ll erschien.", ["Li"], "person", "Herr [X] erschien."),
        ("Das ist passiert.", ["iert"], "number", "Das ist passiert."),
        ("Nummer 7364-KLE-2026 und 7364 - KLE - 2026.", ["7364-KLE-2026"], "number", "Nummer [X] und [X]."),
        ("Zeichen 4711 vergeben, 47110 nicht.", ["4711"], "number", "Zeichen [X] vergeben, 47110 nicht."),
        ("Interessen in Essen.", ["Essen"], "place", "Interessen in [X]."),
        ("wohnhaft Berliner Allee 12 in X, Berliner\nAllee 12", ["Berliner      Allee 12"], "address", "wohnhaft [X] in X, [X]"),
        # orders of names, also without a comma
        ("Schmidt, Maria und Maria Schmidt", ["Maria Schmidt"], "person", "[X] und [X]"),
        ("Wu Li kam.", ["Li Wu"], "person", "[X] kam."),
        ("Maria Schmidt", ["Frau Schmidt, Maria"], "person", "[X]"),
        # full names come before the words of other names
        ("Anna Berger und Hans Berger", ["Anna Maria Berger", "Hans Berger"], "person", "[X] [X] und [X]"),
        # letters set apart, only where the form does not occur as it is
        ("S c h m i t t war da", ["Schmitt"], "person", "[X] war da"),
        ("Schmitt und S c h m i t t", ["Schmitt"], "person", "[X] und S c h m i t t"),
        ("Sch mitt", ["Schmitt"], "person", "[X]"),
        ("die Aschmitt er", ["Schmitt"], "person", "die A[X] er"),
        # words of names: general ones and titles stay
        ("Der Antragsteller Hassan sprach mit Herrn", ["Herrn Antragsteller Hassan"], "person", "Der Antragsteller [X] sprach mit Herrn"),
        ("", ["Li"], "person", ""),
        ("unberührt", [], "person", "unberührt"),
        ("unberührt", ["", "x", "  "], "person", "unberührt"),
    ],
)
def test_cases(text, terms, kind, want):
    assert R.replace_terms(text, terms, "[X]", kind) == want


def _plain(text, terms):
    """The same rules by regular expressions for names of letters a, b and blanks, term after term over what is left."""
    edge = "[^\\W_]"
    listed = [v for t in sorted({t.strip() for t in terms if len(t.strip()) >= 2}, key=lambda t: (-len(t), t)) for v in R.orders(t)]
    words = sorted({w.lower(): w for t in sorted({t.strip() for t in terms if len(t.strip()) >= 2}, key=lambda t: (-len(t), t)) for w in R.words_of(t)}.values(), key=lambda w: (-len(w), w))
    held = [(text, False)]
    for term in [t for t in dict.fromkeys(listed + words) if len(t) >= 2]:
        body = re.sub(r"(?:\\s\*)+", r"\\s*", "".join(r"\s*" if c == " " else r"\s*,\s*" if c == "," else c for c in term))
        short = sum(c.isalnum() for c in term) <= 4
        ending = rf"(?:(?:ens|en|es|n|s)(?!{edge}))?"
        pattern = rf"(?<!{edge}){body}{ending}(?!{edge})" if short else body + ending
        apart = rf"(?<!{edge})" + re.sub(r"(\w)(?=\w)", r"\1\\s{0,2}", term.replace(" ", r" ").replace(",", r",")).replace(" ", r"\s*").replace(",", r"\s*,\s*") + rf"(?!{edge})"
        whole = "".join(x for x, _ in held)
        for own in [pattern] + [apart] * (sum(c.isalnum() for c in term) >= 4):
            taken = [False] * len(whole)
            at = 0
            for x, done in held:
                taken[at : at + len(x)] = [done] * len(x)
                at += len(x)
            hits = []
            for m in re.finditer(f"(?=({own}))", whole, re.IGNORECASE):
                lo, hi = m.span(1)
                if not any(taken[lo:hi]) and (not hits or hits[-1][1] <= lo):
                    hits.append((lo, hi))
            if hits:
                cut, at = [], 0
                # pieces: what was taken before stays as it is
                marks = sorted(hits + [(sum(len(y) for y, _ in held[:k]), sum(len(y) for y, _ in held[: k + 1])) for k, (_, done) in enumerate(held) if done])
                for lo, hi in marks:
                    cut += [(whole[at:lo], False), (whole[lo:hi], True)]
                    at = hi
                held = [p for p in [*cut, (whole[at:], False)] if p[0]]
                break
    return "".join("#" if done else x for x, done in held)


_names = st.lists(st.text("ab ", min_size=1, max_size=9).map(lambda t: " ".join(t.split())), max_size=3)


@settings(max_examples=400, deadline=None)
@given(st.text("ab, n.\n", max_size=40), _names)
def test_equals_regular_expressions(text, names):
    kind = R.Kind(names=True)
    got = R.Terms(names, kind).replace(text, "#")
    assert got == _plain(text, names)


@settings(max_examples=200, deadline=None)
@given(st.text("aSs5iL1 \n-,", max_size=60), st.lists(st.text("aSs5iL1 -", min_size=1, max_size=8), max_size=4))
def test_spans_do_not_overlap_and_a_second_pass_finds_nothing_new(text, terms):
    held = R.Terms(terms, R.KINDS["person"])
    spans = held.spans(text)
    assert all(0 <= a < b <= len(text) for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert spans == held.spans(text)


def test_time_is_linear():
    draw = random.Random(1)
    terms = ["".join(draw.choice("abcdefgh") for _ in range(9)).capitalize() + " " + "".join(draw.choice("abcdefgh") for _ in range(7)).capitalize() for _ in range(180)]
    base = ("Aufnahmeeinrichtung" + " " * 60 + "Feldwert\n") * 400 + " ".join(draw.choice(["wort", "satz", "a", terms[3], "x y z"]) for _ in range(40_000))

    def took(n):
        began = time.perf_counter()
        R.replace_terms(base * n, [*terms, "Aufnahmeeinrichtung" + " " * 10 + "Musterheim"], "[X]")
        return time.perf_counter() - began

    took(1)
    one, four = min(took(1) for _ in range(3)), took(4)
    assert four < 8 * one + 0.5 and four < 20


def test_columns(spark):
    rows = [("Maria Schmidt, Essen, 12.03.1967, 2 . 3 . 67 und 12.0367", ["Maria Schmidt", None], ["Essen"], ["12.03.1967"]), (None, ["x"], None, None), ("bleibt", None, None, [])]
    df = spark.createDataFrame(rows, "t string, names array<string>, places array<string>, born array<string>")
    out = R.redact_terms(df, "t", {"names": ("person", "[PERSON]"), "places": ("place", "[ORT]")}).withColumn("redacted", R.redact_birth_dates(*map(__import__("pyspark.sql.functions", fromlist=["col"]).col, ("redacted", "born"))))
    assert [r.redacted for r in out.collect()] == ["[PERSON], [ORT], [GEBURTSDATUM], [GEBURTSDATUM] und [GEBURTSDATUM]", None, "bleibt"]
    assert out.columns == [*df.columns, "redacted"]


def test_pseudonyms_fail_closed(spark, monkeypatch):
    from loomtext.operators import privacy as P

    rows = [("Maria Schmidt wohnt in Essen.", ["Maria Schmidt", None], ["Essen"]), ("Maria Schmidt", None, None), (None, ["x"], None), ("Die Polizei kam zu Herrn Li.", ["Li"], None), ("Ma-ria Schm idt bleibt lesbar: MariaSchm.idt", ["Maria Schmidt"], None), ("nichts", [], [])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, names array<string>, places array<string>")
    got = [r.pseudonymised for r in P.pseudonymised(df, "t", "names", "places").orderBy("k").collect()]
    assert got == ["[PERSON] wohnt in [ORT].", "", "", "Die Polizei kam zu Herrn [PERSON].", "", "nichts"]
