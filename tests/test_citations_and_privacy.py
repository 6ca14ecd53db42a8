"""Pure parts of citation finding, redaction and name checks; none needs a session."""

from loomtext.operators.citations import find, sentence_at
from loomtext.operators.privacy import plausible_names, restore_markers


def test_citations():
    text = "Der Kläger ist geflohen (vgl. S. 12 f. der Akte). Das folgt aus § 5 Abs. 2 S. 1 AsylG. Er war krank, Bl. 3-5, und blieb, Seite 40 ff."
    got = find(text)
    assert [(c.pages, c.open_end) for c in got] == [((12, 13), False), ((3, 4, 5), False), ((40,), True)]
    assert got[0].claim == "Der Kläger ist geflohen"
    assert got[1].sentence.startswith("Er war krank")
    assert find(None) == [] and find("ohne Seiten") == []


def test_sentences():
    text = "Erster Satz. Dr. Muster kam am 3. Mai. Ende"
    lo, hi = sentence_at(text, text.index("Muster"))
    assert text[lo:hi].strip() == "Dr. Muster kam am 3. Mai."


def test_markers_come_back():
    one, two, three = "the first page speaks of rivers", "another tells of quiet mountains", "and here the sea begins to sing"
    before = f"--- Seite 1 ---\n{one} 12\n--- Seite 2 ---\n{two}\n--- Seite 3 ---\n{three}"
    assert restore_markers(before, before) == before
    assert restore_markers(before, f"--- Seite 1 ---\n{one} 12\n{two}\n--- Seite 3 ---\n{three}") == before
    assert restore_markers(before, f"{one} 12\n{two}\n{three}") == before
    # what is left of a marker is rewritten in its place
    assert restore_markers(before, f"--- Seite 1 ---\n{one} 12\n--- [ORT] ---\nx\n--- Seite 3 ---\n{three}") == before.replace(two, "x")
    # a page that cannot be found again gets no marker
    assert restore_markers(before, f"other\n{three}") == f"other\n--- Seite 3 ---\n{three}"
    assert restore_markers("", "x") == "x" and restore_markers(before, "") == ""


def test_names():
    text = "Ali Hassan kam 2015. Das Urteil Becker, juris Rn. 5. Herr Frau. Behörde Nord. Max 3"
    assert plausible_names(text, ["Ali Hassan", "Ali Hassan", "Becker", "Herr Frau", "Behörde Nord", "Max 3", "ali", "Fehlt", None], context=20) == ["Ali Hassan"]
