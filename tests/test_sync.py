"""States of pages over several crawls, with a restart, an aborted crawl and a partial one."""

from datetime import datetime, timedelta

import pytest

from loomtext.streaming import sync

START = datetime(2026, 1, 1)
LONG = "word " * 60


def crawl(run, hours, pages, failed=(), end=None):
    """Rows of a crawl: pages with their texts, pages that could not be read, and whether it saw the whole site; None if it never ended."""
    at = START + timedelta(hours=hours)
    rows = [("s", run, "page", p, t, None, at + timedelta(seconds=k)) for k, (p, t) in enumerate(pages.items())]
    rows += [("s", run, "failed", p, None, None, at + timedelta(seconds=50)) for p in failed]
    return rows + ([("s", run, "end", None, None, end, at + timedelta(seconds=90))] if end is not None else [])


CRAWLS = [
    crawl(1, 0, {"a": LONG, "b": LONG, "c": "tiny", "e": LONG}, end=True),
    crawl(2, 10, {"a": LONG, "b": LONG + "changed", "d": LONG}),  # aborted
    crawl(3, 20, {"a": LONG}, end=False),  # partial
    crawl(4, 30, {"a": LONG, "d": LONG}, failed=["b"], end=True),
    crawl(5, 50, {"f": None}, end=None),
    crawl(6, 70, {"a": LONG + "!"}, end=None),
    crawl(7, 90, {"c": LONG}, end=None),
]
WANT = [
    ("a", 1, "new"), ("b", 1, "new"), ("c", 1, "thin"), ("e", 1, "new"),
    ("a", 2, "unchanged"), ("b", 2, "updated"), ("d", 2, "new"),
    ("a", 3, "unchanged"),
    ("a", 4, "unchanged"), ("d", 4, "unchanged"), ("b", 4, "failed"),
    ("c", 4, "gone"), ("e", 4, "gone"),
    ("c", 7, "updated"), ("f", 5, "thin"), ("a", 6, "updated"),
]


@pytest.mark.parametrize("stop", [7, 2, 4])
def test_states_over_crawls(spark, tmp_path, stop):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source, out = str(tmp_path / "crawls"), str(tmp_path / "out")

        def run():
            stream = spark.readStream.schema(sync.CRAWL).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
            changes = sync.page_states(stream, least_chars=100, grace=3600.0, buckets=3)
            query = changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()

        for k, rows in enumerate(CRAWLS):
            spark.createDataFrame(rows, sync.CRAWL).coalesce(1).write.parquet(f"{source}/{k:02d}")
            if k + 1 == stop and stop < len(CRAWLS):
                run()  # the state is taken up again by the next run
        run()
        got = sorted((r.page, r.run, r.state) for r in spark.read.parquet(out).collect())
        assert got == sorted(WANT)
    finally:
        spark.conf.unset(key)
