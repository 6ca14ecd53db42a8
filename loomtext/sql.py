"""The SQL surface: views over the tables and functions under SQL names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.chunking import pack
from .operators.citations import find
from .operators.redaction import replace_terms

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Chunks:
    """Table function: (idx, chunk) for a text."""

    def eval(self, text: str, target: int):
        for k, chunk in enumerate(pack(text or "", target, target * 4 // 3)):
            yield k, chunk


class Citations:
    """Table function: (pos, page, open_end) for page citations such as ``S. 12 f.`` in a text; after ``ff.`` all later pages are meant."""

    def eval(self, text: str):
        for c in find(text):
            for page in c.pages:
                yield c.pos, page, c.open_end


def register(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Publish the functions, and the tables of a folder as views."""

    @F.pandas_udf("array<string>")
    def chunk_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: pack(t or ""))

    @F.pandas_udf("string")
    def redact_terms(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, terms in parts:
            yield pd.Series([None if t is None else replace_terms(t, list(x) if x is not None else [], "[PERSON]") for t, x in zip(texts, terms, strict=True)])

    spark.udf.register("chunk_text", chunk_text)
    spark.udf.register("redact_terms", redact_terms)
    spark.udtf.register("chunks_of", F.udtf(Chunks, returnType="idx int, chunk string"))
    spark.udtf.register("citations_of", F.udtf(Citations, returnType="pos int, page int, open_end boolean"))
    if sf_dir:
        for name in TABLES:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
