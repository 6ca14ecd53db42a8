"""Claims and pages meet by document in one task; wide documents meet as before, with the same results."""

import random

import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry
from loomtext.operators import claims as K
from loomtext.operators import verification as V
from loomtext.operators.beside import by_document, parted

WORDS = "Verfolgung Verfolgungen Familienmitglied Familienmitgliedern Antragsteller Syrien Damaskus kurz am der ist Prüfung bestanden Test 12.03.2026 2019 3,5 17 Sicherheitslage Rückkehrgefährdung".split()


def tables(spark, seed=5):
    """Documents of one to nine pages, claims cut from them with slips; repeated, empty and null pages, a document without pages, null documents."""
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    pages = [(d, p, text(draw.randint(0, 40))) for d in range(14) for p in range(1, 2 + d % 9)] + [(3, 1, "aa Syrien"), (3, 2, None), (4, 1, ""), (None, 1, text(9))]
    claims = []
    for d in [*range(16), None]:
        own = [t for e, _, t in pages if e == d and t] or [text(9)]
        for c in range(6):
            words = draw.choice(own).split()
            lo = draw.randrange(len(words))
            said = words[lo : lo + draw.randint(2, 9)]
            said = [w[:6] + w[7:] if c % 2 else w for w in said]
            claims.append((d, c, " ".join(said) if c < 4 else "anders gesagt 1999" if c < 5 else None, draw.choice([[1], [2, 1], [1, 1, 9], [], None, [None, 2]])))
    return spark.createDataFrame(claims, "d int, c int, claim string, cited array<int>"), spark.createDataFrame(pages, "d int, p int, page_text string")


def test_tuples_of_a_document_come_together(spark):
    claims = spark.createDataFrame([(k % 7 if k else None, k, "x") for k in range(300)], "doc int, id int, a string")
    pages = spark.createDataFrame([(k % 9 if k else None, k) for k in range(200)], "doc int, page int")
    least = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        got = by_document(claims, pages, lambda c, p: [(len(c), sum(n for n, in p))], [T.StructField("n", T.IntegerType()), T.StructField("sum", T.IntegerType())]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", least)
    of = lambda n, m, d: [k for k in range(1, n) if k % m == d]
    assert sorted(map(tuple, got), key=repr) == sorted([(d, len(of(300, 7, d)), sum(of(200, 9, d))) for d in range(7)] + [(None, 1, 0)], key=repr)


def test_wide_documents_are_told_apart(spark):
    claims, pages = tables(spark)
    assert parted(claims, pages, "d")[1] is None
    near, far = parted(claims, pages, "d", 6)
    assert {r.d for r in far[1].collect()} == {6, 7, 8} and {r.d for r in near[0].collect()} == {r.d for r in claims.collect()} - {6, 7, 8}


@pytest.mark.parametrize("wide", [0, 6])
def test_wide_documents_give_the_same(spark, wide):
    claims, pages = tables(spark)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    args = claims, pages, "d", "c", "p"
    checked = rows(K.check_claims(*args))
    assert checked == rows(K.check_claims(*args, wide=wide)) and len(checked) == 17 * 6 and len({r[2] for r in checked}) == 5
    once = pages.dropDuplicates(["d", "p"])
    pairs = rows(V.anchored_pairs(claims, once, "d", "c", "p", "claim", "page_text"))
    assert pairs == rows(V.anchored_pairs(claims, once, "d", "c", "p", "claim", "page_text", wide=wide)) and len(pairs) > 30


@pytest.mark.parametrize("name", ["claim_checks", "anchored_claims"])
def test_no_words_of_pages_are_joined(spark, tmp_path, name):
    draw = random.Random(1)
    docs = [(k, " ".join(draw.choice(WORDS) for _ in range(200)), "de") for k in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = entry.queries()[name](spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().toString() and found.count() > 20
