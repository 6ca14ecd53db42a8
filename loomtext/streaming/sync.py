"""Keeping track of a site's pages over many crawls, as a stream with state.

A crawl sends a row for each page it fetched or could not fetch, and one when it has ended. Pages are new, updated, unchanged, thin (hardly any text),
failed, or gone. A page is gone only when a crawl that saw the whole site has ended, a time of grace has passed, and the page was not in it or a later one: a partial
or aborted crawl never makes a page go, however little it saw.

Pages of a site are dealt into buckets, each a key with a map from page to what is known of it, kept by the state store; the end of a crawl
goes to every bucket. So neither a site nor its end is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Rows of a crawl: kind is page, failed or end; whole says, on the last row, that the crawl saw the whole site.
CRAWL = "site string, run long, kind string, page string, text string, whole boolean, ts timestamp"
CHANGES = "site string, page string, run long, state string"
STATES = ("new", "updated", "unchanged", "thin", "gone", "failed")


class PageStates(StatefulProcessor):
    """The states of one bucket's pages."""

    def __init__(self, least_chars: int, grace: float):
        self.least_chars, self.grace = least_chars, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page string", "sha string, run long, active boolean")
        self.ends = handle.getMapState("ends", "due long", "run long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        site, out = key[0], []
        # of one crawl's rows the end is the last, whatever the order they come in
        every = sorted((r for part in rows for r in part[["run", "kind", "page", "sha", "chars", "ts"]].itertuples(index=False, name=None)), key=lambda r: (r[5], r[1] == "end", r[0], r[2] or ""))
        for run, kind, page, sha, chars, ts in every:
            if kind == "end":
                due = int(ts.timestamp() * 1000 + self.grace * 1000)
                held = self.ends.getValue((due,)) if self.ends.containsKey((due,)) else None
                self.ends.updateValue((due,), (max(int(run), held[0]) if held else int(run),))
                self.handle.registerTimer(due)
                continue
            known = self.pages.getValue((page,)) if self.pages.containsKey((page,)) else None
            if kind == "failed":
                out.append((site, page, run, "failed"))
                # the page is there, though nobody could read it: what is known of it stays, but it was not missing
                if known:
                    self.pages.updateValue((page,), (known[0], max(known[1], int(run)), known[2]))
                continue
            same = known is not None and known[2] and known[0] == sha
            state = "unchanged" if same else "thin" if chars < self.least_chars else "new" if known is None else "updated"
            out.append((site, page, run, state))
            self.pages.updateValue((page,), (sha, max(known[1], int(run)) if known else int(run), True))
        yield pd.DataFrame(out, columns=["site", "page", "run", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, out = expiredTimerInfo.getExpiryTimeInMs(), []
        if self.ends.containsKey((due,)):
            run = self.ends.getValue((due,))[0]
            missing = [(k[0], v) for k, v in self.pages.iterator() if v[2] and v[1] < run]
            for page, (sha, last, _) in missing:
                self.pages.updateValue((page,), (sha, last, False))
                out.append((key[0], page, run, "gone"))
            self.ends.removeKey((due,))
        yield pd.DataFrame(out, columns=["site", "page", "run", "state"])

    def close(self) -> None:
        pass


def page_states(crawls: DataFrame, least_chars: int = 200, grace: float = 3600.0, late: str = "1 hour", buckets: int = 64) -> DataFrame:
    """Changes of pages (site, page, run, state) from a stream of crawls in the form of ``CRAWL``.

    Runs are numbered in the order of crawls. The session's state store has to be RocksDB's. Ends of crawls that did not see the whole site are left
    out; ``grace`` (seconds) is how long rows of a crawl may follow its end, and ``late`` how far behind the latest a row may be. A page that was gone
    and comes back is updated; one that failed is not gone, nor is one that is seen again before its absence is settled. Rows without a page or time are left out.
    """
    timed = crawls.where(F.col("ts").isNotNull()).withWatermark("ts", late)
    page = timed.where(F.col("kind").isin("page", "failed") & F.col("page").isNotNull()).withColumn("bucket", F.pmod(F.xxhash64("page"), F.lit(buckets)).cast("int"))
    end = timed.where((F.col("kind") == "end") & F.col("whole")).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    text = F.coalesce("text", F.lit(""))
    shape = ["site", "bucket", "run", "kind", "page", F.sha2(text, 256).alias("sha"), F.length(text).alias("chars"), "ts"]
    rows = page.select(*shape).unionByName(end.select(*shape))
    processor = PageStates(least_chars, grace)
    return rows.groupBy("site", "bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")
