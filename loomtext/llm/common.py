"""What the corpus operators share: scratch tables, keys of rows, file access."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as a regular expression class and as bytes.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only for a local master without it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="loomtext-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file API."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_all(spark: SparkSession, paths: list[str]) -> None:
    try:
        for path in paths:
            drop_path(spark, path)
    except Exception:  # noqa: BLE001  the gateway may be gone at interpreter exit
        pass


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage the way a reliable checkpoint does, but in columns, so that later readers prune.
    The shuffle files of the job that wrote the table are freed when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loomtext/{tag}-{uuid.uuid4().hex}"
    if spark not in _made:
        _made[spark] = []
        atexit.register(_drop_all, spark, _made[spark])
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    _made[spark].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the scratch table behind a frame from :func:`materialize` that nothing reads any more."""
    if path := getattr(df, "_scratch", None):
        drop_path(df.sparkSession, path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Hold one session setting for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in ``sf_dir``, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two non-null longs, ``_kid`` and ``_kth``, that tell rows apart: the id and a hash of id and text.

    Rows with equal id and text share a key; whatever an operator derives from the text is equal for them too.
    """
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_kid"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("_kth"),
    ]


class Carried:
    """A table with its columns renamed out of the way of an operator's own, and back again.

    ``frame`` has the text as ``text``, the keys of :func:`row_key` and every other column as ``_c0``, ``_c1``, ...;
    columns named in ``without`` are left out, as the operator returns its own under these names.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, without: set[str]):
        self.names = [c for c in docs.columns if c not in without]
        self.own = [f"_c{k}" for k in range(len(self.names))]
        self.frame = docs.select(
            *(F.col(f"`{c}`").alias(k) for c, k in zip(self.names, self.own, strict=True)),
            F.col(f"`{text_col}`").cast("string").alias("text"),
            *row_key(f"`{id_col}`", f"`{text_col}`"),
        )

    def schema(self, more: str) -> T.StructType:
        """Of a function that gives back the carried columns and those of ``more``."""
        return T.StructType([self.frame.schema[k] for k in self.own] + T.StructType.fromDDL(more).fields)

    def restored(self, df: DataFrame, *results: str) -> DataFrame:
        return df.select(*(F.col(k).alias(c) for k, c in zip(self.own, self.names, strict=True)), *results)
