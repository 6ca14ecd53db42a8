"""Session builder with the settings the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "loomtext", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; extra settings override the defaults."""
    cores = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": cores,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("LOOMTEXT_DRIVER_MEMORY", "12g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app).master(master or f"local[{cores}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
