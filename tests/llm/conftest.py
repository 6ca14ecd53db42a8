import random

import pytest

SCHEMA = "doc_id long, text string, source string, lang string, kept_text string, size int, shard string, _kid int, _c0 string, component_id string, score string, rule string, ids string, n_words int, taken int, keep_bitmap int"


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, source): nulls, empty and long texts, copies, near copies, ties, repeated rows, non-ASCII text."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice(["ka", "lo", "mi", "ÉT", "ü", "Zen", "漢", "x1"]) for _ in range(draw.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, line, passage = prose(80), "  A shared LINE of some length \t", prose(60)
    near = base.split()
    near[40] = "changed"
    out = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, base, "a"), (5, base, "b"), (6, " ".join(near), "b"), (7, base.upper(), "c"),
        (8, f"{line}\n{prose(30)}", "a"), (9, f"{prose(30)}\n{line.strip()}\n{line}", "b"), (10, f"{line.lower()}\r\n{prose(9)}", "a"),
        (11, f"{prose(20)} {passage} {prose(20)}", "a"), (12, f"{passage} {prose(7)}", "c"), (13, prose(13) + "\n\n" + passage, None),
        (14, "a", "a"), (15, "b c", "a"), (16, "b  c\n", "b"), (17, "one two three four five", "c"), (17, "one two three four five", "c"),
        (18, "x" * 5000, "a"), (19, prose(20000), "b"), (20, "be " * 300, "b"), (None, base, "c"), (None, None, None), (21, "tie one", "a"), (21, "tie two", "a"),
    ]
    return out + [(30 + k, prose(draw.randint(0, 120)), draw.choice(["a", "b", "c", None])) for k in range(40)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    clash = ("old", 9, "old", 9, "old", "old", "old", "old", "old", 9, 9, 9)
    return spark.createDataFrame([(i, t, s, "xx", *clash) for i, t, s in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
