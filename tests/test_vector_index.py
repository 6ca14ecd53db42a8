"""The index of cells: every row in it, exact with all cells probed, recall of the default measured."""

import numpy as np
import pytest

from loomtext.operators import retrieval as R
from loomtext.operators import vector_index as X


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(5)
    middles = draw.normal(size=(30, 16))
    rows = [(k, (middles[k % 30] + 0.4 * draw.normal(size=16)).tolist()) for k in range(2000)]
    # a third of all rows in one place
    rows += [(2000 + k, (middles[0] + 0.01 * draw.normal(size=16)).tolist()) for k in range(1000)]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [1.0] * 3), (4004, [None] * 16), (4005, [float("nan")] * 16)]
    return spark.createDataFrame(rows, "k long, v array<double>").repartition(6).cache()


def queries(table):
    return table.where("k % 20 = 0").selectExpr("k AS query_id", "v AS query")


def test_recall_against_all_rows(spark, table, monkeypatch):
    monkeypatch.setattr(X, "ROWS", 100)
    monkeypatch.setattr(X, "ASKS", 7)
    centres = X.fit(table, "k", "v", cells=24, sample_bytes=40_000)
    index = X.build(table, centres, "k", "v")
    assert index.count() == table.count()
    # rows that have no direction are ranked apart by the exact search
    usable = queries(table).where("query_id < 4000")
    exact = R.knn(table.where("k < 4000"), usable, "k", "v", 10)
    found = X.search(index, centres, usable, "k", "v", 10, probes=8)
    share = X.recall(found, exact, "k")
    assert share >= 0.9
    every = X.search(index, centres, usable, "k", "v", 10, probes=len(centres))
    # rounding may turn neighbours of equal score
    pairs = lambda df: {(r.query_id, r["rank"]): round(r.score, 9) for r in df.collect()}
    assert pairs(every) == pairs(exact)


def test_odd_queries_and_empty_tables(spark, table):
    centres = X.fit(table, "k", "v", cells=8)
    got = X.search(X.build(table, centres, "k", "v"), centres, spark.createDataFrame([("z", None), ("n", [0.0] * 16)], "query_id string, query array<double>"), "k", "v", 3, probes=2).collect()
    assert {r.query_id for r in got} == {"z", "n"} and all(r.score == 0.0 for r in got)
    none = table.limit(0)
    empty = X.fit(none, "k", "v")
    assert len(empty) == 0 and X.search(X.build(none, np.zeros((1, 16)), "k", "v"), np.zeros((1, 16)), queries(table), "k", "v", 3).collect() == []
