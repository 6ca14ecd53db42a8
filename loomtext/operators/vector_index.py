"""An index of vectors by cells: fitted on a bounded sample, holding every row, searched in the cells nearest to a query.

Cells are those of spherical k-means centres. Rows and queries of a cell meet as blocks of bounded size, matrix against matrix, so a cell with very many rows is
many tasks' work and no group is collected. With all cells probed the result is exact; with fewer it is what the probed cells hold, and
:func:`recall` says how much of the exact result that is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a block of the index, queries of a block, and lanes that the rows of a cell are dealt to.
ROWS, ASKS, LANES = 2048, 512, 16


def fit(vectors: DataFrame, key: str, vector: str, cells: int = 64, sample_bytes: int = 32 << 20, rounds: int = 12) -> np.ndarray:
    """Unit centres, at most ``cells``, from a sample of about ``sample_bytes`` that follows from a hash of the keys.

    Vectors of the most frequent width count; null, empty and zero ones and those with null or non-finite components do not. No rows give no centres.
    """
    usable = vectors.where((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()))
    widths = usable.groupBy(F.size(vector).alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    if not widths:
        return np.zeros((0, 0))
    width, n = widths[0]
    most = max(1, sample_bytes // (8 * width))
    share = usable.where(F.size(vector) == width)
    if n > most:
        share = share.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / n)))
    held = np.array([r[0] for r in share.select(vector).limit(2 * most).collect()], np.float64).reshape(-1, width)  # bounded by sample_bytes
    norm = np.sqrt((held * held).sum(axis=1))
    held = held[np.isfinite(norm) & (norm > 0)] / norm[np.isfinite(norm) & (norm > 0), None]
    held = np.unique(held, axis=0)
    if not len(held):
        return np.zeros((0, width))
    draw = np.random.default_rng(7)
    centres = held[draw.choice(len(held), min(cells, len(held)), replace=False)]
    for _ in range(rounds):
        near = (held @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, held)
        size = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return centres


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are of that width and without null components, and their values."""
    keep = np.array([v.is_valid and len(v.values) == width and not v.values.null_count for v in column], bool)
    rows = [v.values.to_numpy(zero_copy_only=False) for v, k in zip(column, keep, strict=True) if k]
    return keep, np.array(rows, np.float64).reshape(len(rows), width)


def _nearest_cells(shared, vector: str, probes: int, schema: T.StructType):
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(vector))
            keep, values = _matrix(column, centres.shape[1])
            # what has no direction of that width is filed under a cell of its own, which every query looks at
            cells = [[len(centres)] for _ in range(batch.num_rows)]
            if len(values):
                with np.errstate(all="ignore"):
                    near = np.nan_to_num(values @ centres.T, nan=-np.inf)
                ranked = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                for k, own in zip(np.flatnonzero(keep).tolist(), ranked.tolist(), strict=True):
                    cells[k] = own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], schema=target)

    return run


def _placed(df: DataFrame, centres: np.ndarray, vector: str, probes: int) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(centres)  # as many as fit was asked for
    schema = T.StructType([*df.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(_nearest_cells(shared, vector, probes, schema), schema)


def build(vectors: DataFrame, centres: np.ndarray, key: str, vector: str) -> DataFrame:
    """``vectors`` (key, vector) with ``cell``, the index's rows: to be written, by cell, and read again for searches. Every row is there."""
    return _placed(vectors.select(key, vector), centres, vector, 1).select(key, vector, F.col("cells")[0].alias("cell"))


def _packed(df: DataFrame, size: int, name: str) -> DataFrame:
    """Up to ``size`` rows of a partition and cell as one row with arrays; rows have to be sorted by cell."""
    fields = [f for f in df.schema.fields if f.name != "cell"]
    schema = T.StructType([T.StructField("cell", T.IntegerType()), *(T.StructField(f"{name}_{f.name}", T.ArrayType(f.dataType)) for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(batch.schema.get_field_index("cell")).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)] if len(cells) else [0]
            for lo, hi in zip(edges, edges[1:], strict=False):
                for at in range(lo, hi, size):
                    part = batch.slice(at, min(size, hi - at))
                    whole = pa.array([0, part.num_rows], pa.int32())
                    lists = [pa.ListArray.from_arrays(whole, part.column(part.schema.get_field_index(f.name))) for f in fields]
                    yield pa.RecordBatch.from_arrays([pa.array([int(cells[lo])], pa.int32()), *lists], names=schema.names)

    return df.mapInArrow(run, schema)


def search(index: DataFrame, centres: np.ndarray, queries: DataFrame, key: str, vector: str, k: int, probes: int = 8) -> DataFrame:
    """(query_id, key, score, rank): for each of the ``queries`` (query_id, query) the ``k`` rows of largest cosine in its ``probes`` nearest cells.

    Ties go to the smaller key. Rows of another width than the query's, zero ones and such with null or non-finite components score 0; they are filed in a cell of their own that all queries
    look at. Queries that have no direction themselves find every row they meet at 0. An empty index gives an empty result.
    """
    cells = len(centres)
    asked = _placed(queries.select("query_id", "query"), centres, "query", max(1, min(probes, cells))) if cells else queries.select("query_id", "query").withColumn("cells", F.array().cast("array<int>"))
    # a query goes to all lanes of its cells, so that a cell with very many rows is no task's alone
    asked = asked.select("query_id", "query", F.explode(F.array_union("cells", F.array(F.lit(cells)))).alias("cell")).select("query_id", "query", F.explode(F.sequence(F.col("cell") * LANES, F.col("cell") * LANES + LANES - 1)).alias("cell"))
    lane = (F.col("cell") * LANES + F.pmod(F.xxhash64(key), F.lit(LANES)).cast("int")).alias("cell")
    rows = _packed(index.select(key, vector, lane).repartition("cell").sortWithinPartitions("cell"), ROWS, "row")
    asks = _packed(asked.repartition("cell").sortWithinPartitions("cell"), ASKS, "ask")
    kinds = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField(key, index.schema[key].dataType), T.StructField("score", T.DoubleType())]
    schema = T.StructType(kinds)
    types = to_arrow_schema(schema).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: E731, B023
            for i in range(batch.num_rows):
                ids, keys = column("ask_query_id")[i].values, column(f"row_{key}")[i].values
                score = np.zeros((len(ids), len(keys)))
                width = centres.shape[1] if cells else 0
                own, x = _matrix(column("ask_query")[i].values, width)
                theirs, y = _matrix(column(f"row_{vector}")[i].values, width)
                if width and len(x) and len(y):
                    with np.errstate(all="ignore"):
                        norm = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))
                        score[np.ix_(own, theirs)] = np.where((norm > 0) & np.isfinite(norm), (x @ y.T) / norm, 0.0)
                order = np.array(keys.to_pylist(), object)
                tie = np.argsort(np.argsort(keys.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
                for q in range(len(ids)):
                    best = np.lexsort((tie, -np.round(score[q], 12)))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[q].as_py()] * len(best), types[0]), pa.array(order[best].tolist(), types[1]), pa.array(score[q][best])], names=schema.names)

    found = asks.join(rows, "cell").mapInArrow(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.col(key))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, key: str) -> float:
    """What part of the exact hits (query_id, key) was found."""
    both = exact.select("query_id", key).join(found.select("query_id", key).withColumn("_hit", F.lit(1)), ["query_id", key], "left")
    hit, n = both.agg(F.count("_hit"), F.count(F.lit(1))).first()
    return hit / n if n else 1.0
