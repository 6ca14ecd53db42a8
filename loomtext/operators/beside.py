"""Claims and pages of a document side by side in one task, so that its pairs are formed where they are compared."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..scratch import cut
from ..sources.tables import spread

#: Pages or claims of a document that one task takes at once, at most; the pairs of wider documents are dealt over tasks.
WIDE = 1000
_PART = 4096


def parted(claims: DataFrame, pages: DataFrame, doc: str, wide: int = WIDE) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame] | None]:
    """Claims and pages of documents with ``wide`` of either at most, and those of the others, if there are any."""
    each = pages.select(doc, F.lit(1).alias("p"), F.lit(0).alias("c")).union(claims.select(doc, F.lit(0), F.lit(1)))
    large = cut(each.where(F.col(doc).isNotNull()).groupBy(doc).agg(F.sum("p").alias("p"), F.sum("c").alias("c")).where((F.col("p") > wide) | (F.col("c") > wide)).select(doc))
    if large.isEmpty():
        return (claims, pages), None
    some = lambda how: tuple(df.join(large, doc, how) for df in (claims, pages))
    return some("left_anti"), some("left_semi")


def by_document(claims: DataFrame, pages: DataFrame, made: Callable[[list[tuple], list[tuple]], Iterable[tuple]], fields: list[StructField]) -> DataFrame:
    """(doc, *fields): what ``made`` gives for the claims and the pages of each document.

    Both have a column ``doc`` and hand over tuples of the others. They are dealt by document, once; a task holds one document at a time, so wide ones are to be
    taken out before. Pages without a document meet no claim: they are left out only here, so that claims and pages cut from one text can share its exchange.
    """
    own, theirs = ([c for c in df.columns if c != "doc"] for df in (claims, pages))
    c, p = F.struct(*own).alias("c"), F.struct(*theirs).alias("p")
    said = claims.select("doc", c).withColumn("p", F.lit(None).cast(pages.select(p).schema["p"].dataType))
    held = pages.select("doc", p).withColumn("c", F.lit(None).cast(claims.select(c).schema["c"].dataType))
    schema = StructType([claims.schema["doc"], *fields])
    arrow = to_arrow_schema(schema)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        doc, said, held = None, [], []
        for b in batches:
            rows = [zip(*(x.to_pylist() for x in b.column(name).flatten()), strict=True) for name in ("c", "p")]
            for new, claimed, a, z in zip(b.column("doc").to_pylist(), b.column("c").is_valid().to_pylist(), *rows, strict=True):
                if new != doc or (new is None and len(said) >= _PART):
                    yield doc, said, held
                    doc, said, held = new, [], []
                if claimed:
                    said.append(a)
                elif new is not None:
                    held.append(z)
        yield doc, said, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for doc, said, held in documents(batches):
            if said:
                out += ((doc, *r) for r in made(said, held))
            if len(out) >= _PART:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    return spread(said.unionByName(held), "doc").sortWithinPartitions("doc").mapInArrow(run, schema)
