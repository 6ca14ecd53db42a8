"""Cutting the lineage of iterative work in the folder that the session names for it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> None:
    """See to it that the session has a checkpoint folder: that of spark.checkpoint.dir, or a temporary one only for a local master without it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomtext-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the checkpoint folder, which outlives executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
