"""Context blocks under a character budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pack_blocks(df: DataFrame, key: str, order: str, text: str, budget: int, least: int = 800) -> DataFrame:
    """Per key the texts in order while they fit; one that does not is cut at a line end if ``least`` characters remain, else skipped.

    Keys are dealt out and sorted; one pass keeps a running budget per key and sees no more than ``budget`` characters of a text, so
    neither a key nor a text has to fit into memory. What it takes is put together afterwards.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, left = None, budget
        for batch in batches:
            out = []
            for k, at, size, head in batch.itertuples(index=False, name=None):
                if k != held:
                    held, left = k, budget
                if size > left:
                    if left < least:
                        continue
                    head = head[:left].rsplit("\n", 1)[0]
                out.append((k, at, head))
                left -= len(head)
            yield pd.DataFrame(out, columns=["key", "at", "piece"])

    c = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.col(order).alias("at"), F.length(c).alias("size"), F.substring(c, 1, budget).alias("head")).where("key is not null")
    kinds = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("at", df.schema[order].dataType), T.StructField("piece", T.StringType())])
    taken = rows.repartition("key").sortWithinPartitions("key", "at").mapInPandas(run, kinds)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])
    return taken.groupBy(F.col("key").alias(key)).agg(F.array_join(pieces, "\n\n").alias("block"), F.count(F.lit(1)).cast("int").alias("used"))


def pack_prefix(df: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """Per key the rows whose running length stays within the budget: the form that needs no fold."""
    from pyspark.sql import Window

    run = F.sum(F.length(text)).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_run", run).where(F.col("_run") <= budget).drop("_run")
