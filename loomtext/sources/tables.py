"""Scans: tables by name, file manifests, owner-scoped and paged reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over several tasks a core, for steps that work long on each row.

    A file of few row groups is read by as few tasks, and exchanges are coalesced by bytes, which say nothing of such work. Rows that share keys stay together.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """:func:`spread` where one task would read more than two cores' share of a table; a table of many row groups stays where it is, without a shuffle of its texts."""
    tasks = [r[0] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).select("n").collect()]  # a row a task; reads no column
    return spread(df, *keys) if max(tasks, default=0) * df.sparkSession.sparkContext.defaultParallelism > 2 * sum(tasks) else df


def files(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """Every file below a folder with its path, size, time and bytes; extensions are pushed into the listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{%s}" % ",".join(extensions))
    return reader.load(folder)


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows that do not depend on partitioning: those with the least hash of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def manifest(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON-lines manifest with a fixed schema; blank lines are skipped, broken ones become nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def latest_file(spark: SparkSession, path: str) -> DataFrame:
    """The file of most recent change time that matches a glob."""
    listing = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return listing.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def scoped(df: DataFrame, owner: str | int | None, owner_col: str = "owner_id") -> DataFrame:
    """Rows that are public or the owner's: the view through which every scan of private data goes."""
    mine = F.col(owner_col) == F.lit(owner) if owner is not None else F.lit(False)
    return df.where(F.col(owner_col).isNull() | mine)


def page_after(df: DataFrame, key: str, cursor, n: int) -> DataFrame:
    """Keyset page: the ``n`` rows after ``cursor`` in key order."""
    rest = df if cursor is None else df.where(F.col(key) > F.lit(cursor))
    return rest.orderBy(key).limit(n)


def export_page(df: DataFrame, key: str, cursor, n: int) -> DataFrame:
    """A keyset page with ``next_cursor``: the last key of the page if it is full, null on a short one. Only the page's rows are sorted on the driver's side of the limit."""
    page = page_after(df, key, cursor, n)
    last = page.agg(F.when(F.count(F.lit(1)) == n, F.max(key)).alias("next_cursor"))  # one row
    return page.join(F.broadcast(last))


def in_scope(df: DataFrame, owner: str | int | None, scope_col: str = "scope", owner_col: str = "owner_id") -> DataFrame:
    """Rows that the whole firm shares or that are the owner's."""
    mine = F.col(owner_col) == F.lit(owner) if owner is not None else F.lit(False)
    return df.where(F.coalesce(F.col(scope_col) == "firm", F.lit(False)) | F.coalesce(mine, F.lit(False)))


def page_at(df: DataFrame, order: list[Column], offset: int, n: int) -> DataFrame:
    """Offset page in a total order."""
    return df.orderBy(*order).offset(offset).limit(n)
