"""Searches whose texts stay where they are, against postings and plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomtext.operators import retrieval as R
from loomtext.sources.tables import dealt


def written(spark, folder, **tables):
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return str(folder)


def corpus(draw, n=70):
    """Documents with copies, empty and null texts, and passages of which one has no known word."""
    words = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(draw.choices(words, k=draw.randint(1, 40)))) for k in range(n)]
    docs += [(n + k, docs[k % 3][1]) for k in range(20)] + [(n + 20, None), (n + 21, ""), (n + 22, " . ")]
    return docs, [(k, " ".join(draw.choices(words, k=12))) for k in range(25)] + [(25, "nowhere"), (26, ""), (27, None)]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scores_in_place_equal_those_of_postings(spark):
    docs, asked = corpus(random.Random(4))
    for kind, key in (("long", lambda k: k), ("string", lambda k: f"ä{k}")):
        texts = spark.createDataFrame([(key(k), t) for k, t in docs], f"d {kind}, t string").repartition(5)
        terms = spark.createDataFrame(asked, "query_id int, q string").select("query_id", F.explode(R.terms_of(F.col("q"))).alias("term"))
        want = sorted(map(tuple, R.bm25(R.postings(texts, "d", "t"), terms, "d", 7).select("query_id", "d", "rank", "score").collect()))
        for sent in (900, 16 << 20):  # many parts, one part
            assert sorted(map(tuple, R.bm25_search(texts, terms, "d", "t", 7, sent=sent).select("query_id", "d", "rank", "score").collect())) == want and len(want) > 150
    assert R.bm25_search(texts, terms.limit(0), "d", "t", 7).collect() == [] and R.bm25_search(texts.limit(0), terms, "d", "t", 7).collect() == []


def test_strips_sum_alike():
    own = R._Terms([(k, ["a", "b", "c"][: k % 3 + 1]) for k in range(9)])
    rows, ids = [x.ravel() for x in np.indices((8, 3))]
    weight = (rows + 1.0) * (ids + 1)
    one, many = ([s.tolist() for _, s in own.scored(rows, ids, weight, 8, strip)] for strip in (1 << 21, 40))
    assert len(one) == 1 and len(many) > 3 and sum(many, []) == one[0] and one[0][1] == [2.0, 6.0, 12.0] * 3


def test_pairs_of_query_and_document_are_not_shuffled(spark, tmp_path):
    docs, asked = corpus(random.Random(5))
    vectors = [(k, [random.Random(k).gauss(0, 1) for _ in range(4)], 0) for k in range(60)]
    folder = written(spark, tmp_path, documents=("doc_id long, text string", docs), benchmark=("item_id long, text string", asked), embeddings=("vec_id long, embedding array<double>, label int", vectors))
    for name in ("sparse_bm25", "rank_fusion"):
        said = plan(entry.queries()[name](spark, folder))
        # nothing is counted or added up by document after the search
        assert "HashAggregate(keys=[query_id" not in said and "HashAggregate(keys=[term" not in said


def test_tables_of_many_tasks_are_not_dealt(spark, tmp_path):
    rows = [(k, "text") for k in range(800)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(16).write.parquet(f"{tmp_path}/many")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/one")
    assert "RepartitionByExpression" not in plan(dealt(spark.read.parquet(f"{tmp_path}/many"), "doc_id"))
    one = dealt(spark.read.parquet(f"{tmp_path}/one"), "doc_id")
    assert "RepartitionByExpression" in plan(one) and one.count() == 800


def test_texts_are_fetched_without_a_shuffle(spark, tmp_path):
    docs, asked = corpus(random.Random(6))
    folder = written(spark, tmp_path, documents=("doc_id long, text string", docs), benchmark=("item_id long, text string", asked))
    texts, hits = spark.read.parquet(f"{folder}/documents.parquet"), spark.createDataFrame([(q, k) for q in range(9) for k in range(0, 99, q + 1)], "q int, doc_id long")
    want = sorted((k, t, q) for q, k in map(tuple, hits.collect()) for i, t in docs if i == k)
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table too large to be sent
        for sent in (800, 16 << 20):
            got = R.sent_to(texts, hits, "doc_id", sent)
            assert sorted(map(tuple, got.select("doc_id", "text", "q").where("text is not null").collect())) == [x for x in want if x[1] is not None] and got.count() == len(want)
        assert "SortMergeJoin" not in plan(entry.queries()["distinct_passages"](spark, folder))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


def test_reranked_orders_fused_hits(spark, tmp_path):
    draw = random.Random(7)
    docs, asked = corpus(draw)
    vectors = [(k, [draw.gauss(0, 1) for _ in range(4)], 0) for k in range(130)]
    folder = written(spark, tmp_path, documents=("doc_id long, text string", docs), benchmark=("item_id long, text string", asked), embeddings=("vec_id long, embedding array<double>, label int", vectors))
    texts, said = dict(docs), {k: t for k, t in asked if t is not None}
    want = []
    fused = entry.queries()["rank_fusion"](spark, folder).collect()
    for q in {r.query_id for r in fused}:
        score = lambda r: len({*said[q].split()} & {*texts[r.id].split()}) if q in said and texts.get(r.id) is not None else -1  # noqa: B023, E731
        best = sorted((r for r in fused if r.query_id == q), key=lambda r: (-score(r), r.rank))[:5]
        want += [(q, r.id, n + 1) for n, r in enumerate(best)]
    got = sorted(map(tuple, entry.queries()["reranked"](spark, folder).select("query_id", "doc_id", "place").collect()))
    assert got == sorted(want) and {q for q, _, _ in got} >= {0, 20, 40, 120}
    # some of the hits have vectors alone to speak for them
    sparse = {(r.query_id, r.doc_id) for r in entry.queries()["sparse_bm25"](spark, folder).collect()}
    assert any(q < 25 and (q, k) not in sparse for q, k, _ in got)
