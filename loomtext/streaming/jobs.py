"""Stateful operators: streams, and the ordered folds of queues and patch logs."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folded(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable, end: Callable | None, schema: str) -> DataFrame:
    """The rows that ``step(state, row)`` gives for each row of a key in ``order``, and ``end(state)`` after the last one.

    Keys are dealt and sorted by Spark and read in batches: a task holds one state and one batch, however many rows a key has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = [f.split()[0] for f in schema.split(", ")]
        now, state, open_ = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                k = getattr(row, key)
                if not open_ or k != now:
                    if open_ and end:
                        out += end(state)
                    now, state, open_ = k, start(), True
                out += step(state, row)
            yield pd.DataFrame(out, columns=fields)
        if open_ and end:
            yield pd.DataFrame(end(state), columns=fields)

    return df.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def cooldown(df: DataFrame, key: str, ident: str, ts: str, seconds: int) -> DataFrame:
    """Rows of each key that come at least ``seconds`` after the last accepted one, in order of time; rows without key or time go."""

    def step(state: dict, row) -> list[tuple]:
        t = getattr(row, ts)
        if "last" in state and (t - state["last"]).total_seconds() < seconds:
            return []
        state["last"] = t
        return [(getattr(row, key), getattr(row, ident))]

    kind = lambda c: f"{c} {df.schema[c].dataType.simpleString()}"
    return folded(df.where(F.col(ts).isNotNull()).select(key, ident, ts), key, [ts, ident], dict, step, None, f"{kind(key)}, {kind(ident)}")


def schedule(requests: DataFrame, worker: str, ident: str, arrival: str, service: str, seconds: str, services: Sequence[str]) -> DataFrame:
    """(worker, request, turn, starts, switch): how a worker that is slow to change service works off its requests.

    It stays with its service while requests for it wait and then takes the first of ``services`` that has some; within a service requests
    go in order of arrival, and one that arrives when the worker becomes free counts as waiting. Requests for other services and
    without a time are refused. ``arrival`` and ``seconds`` are whole seconds. A task holds the requests that wait, no others.
    """
    order = list(services)

    def begin() -> dict:
        return {"free": 0, "service": None, "turn": 0, "queues": {s: deque() for s in order}}

    def turns(state: dict, until: int | None) -> list[tuple]:
        out, queues = [], state["queues"]
        while (until is None or state["free"] < until) and any(queues.values()):
            one = state["service"] if state["service"] and queues[state["service"]] else next(s for s in order if queues[s])
            k, request, takes = queues[one].popleft()
            out.append((k, request, state["turn"], state["free"], one != state["service"]))
            state.update(service=one, turn=state["turn"] + 1, free=state["free"] + takes)
        return out

    def step(state: dict, row) -> list[tuple]:
        t = int(getattr(row, arrival))
        out = turns(state, t)
        if not any(state["queues"].values()):
            state["free"] = max(state["free"], t)
        state["queues"][getattr(row, service)].append((getattr(row, worker), getattr(row, ident), int(getattr(row, seconds))))
        return out

    known = requests.where(F.col(service).isin(order) & F.col(arrival).isNotNull()).select(worker, ident, arrival, service, F.coalesce(F.col(seconds), F.lit(0)).alias(seconds))
    kind = lambda c, n: f"{n} {requests.schema[c].dataType.simpleString()}"
    schema = f"{kind(worker, worker)}, {kind(ident, 'request')}, turn long, starts long, switch boolean"
    return folded(known, worker, [arrival, ident], begin, step, lambda state: turns(state, None), schema)


def claim(jobs: DataFrame, queue: str, job: str, now) -> DataFrame:
    """The job that each queue gives next: available by ``now`` or at any time, by (available_at, created_at), those without a time last."""
    from ..operators.merge import first_by

    ready = jobs.where(F.col("available_at").isNull() | (F.col("available_at") <= now))
    return first_by(ready, [queue], [F.col("available_at").asc_nulls_last(), F.col("created_at").asc_nulls_last(), F.col(job)])


def sticky_switches(df: DataFrame, worker: str, position: str, service: str) -> DataFrame:
    """How often a worker changes service if it drains one queue, in order of first arrival, before the next."""

    first = df.groupBy(worker, service).agg(F.min(position).alias("first"))
    return first.groupBy(worker).agg((F.count(F.lit(1)) - 1).alias("switches"))


def apply_patches(ops: DataFrame, target: str, allowed: list[str]) -> DataFrame:
    """The state of each target after its operations (version, op, path, value) in version order.

    append adds a value that is not there yet, set replaces the list, remove clears it; paths that are not allowed are
    skipped. A version counts once: of several operations that claim it the first by path, operation and value is applied, and those without a version are
    refused. Returns the target, its number of applied operations, how many were refused, and its state as JSON. A target's log is
    streamed in order; a task holds one state.
    """

    def begin() -> dict:
        return {"lists": {p: [] for p in allowed}, "version": None, "applied": 0, "refused": 0, "key": None}

    def step(state: dict, row) -> list[tuple]:
        state["key"] = getattr(row, target)
        if pd.isna(row.version) or row.version == state["version"]:
            state["refused"] += 1
            return []
        state["version"] = row.version
        held = state["lists"].get(row.path)
        if held is None:
            return []
        if row.op == "append" and row.value not in held:
            held.append(row.value)
        elif row.op == "set" and held != [row.value]:
            held[:] = [row.value]
        elif row.op == "remove" and held:
            held.clear()
        else:
            return []
        state["applied"] += 1
        return []

    def end(state: dict) -> list[tuple]:
        return [(state["key"], state["applied"], state["refused"], json.dumps(state["lists"], sort_keys=True))]

    kind = ops.schema[target].dataType.simpleString()
    return folded(ops.select(target, "version", "path", "op", "value"), target, ["version", "path", "op", "value"], begin, step, end, f"{target} {kind}, applied long, refused long, state string")


def streamed_rollup(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Counts and sums by event type from a file stream that runs until it has read what is there."""
    import uuid

    name = f"rollup_{uuid.uuid4().hex}"
    folder, _, leaf = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", leaf).option("recursiveFileLookup", "false").parquet(folder)
    rolled = stream.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    running = rolled.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)


def _versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the complete versions of a table, from its folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    names = [f.getPath().getName() for f in files.listStatus(where)]
    return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/{n}/_SUCCESS")))


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest version of a table kept by :func:`latest_wins`, without its positions; None if there is none yet."""
    held = _versions(spark, target)
    return spark.read.parquet(f"{target}/v{held[-1]}").drop("_position") if held else None


def latest_wins(spark: SparkSession, stream: DataFrame, target: str, key: str, position: str, checkpoint: str, keep: int = 2):
    """Keep a Parquet table of the last row per key up to date from a stream: one merge for each micro-batch.

    Batch n writes version n + 1 from the newest version before it, so a batch that is repeated after a failure gives the same table; a
    version that cannot be read fails the batch. A row that comes late does not replace one of a later position. Older versions than
    ``keep`` go.
    """
    from ..operators.merge import first_by

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        held = [v for v in _versions(session, target) if v <= number]
        every = batch.withColumnRenamed(position, "_position")
        if held:
            every = every.unionByName(session.read.parquet(f"{target}/v{held[-1]}"))
        first_by(every, [key], [F.col("_position").desc_nulls_last()]).write.mode("overwrite").parquet(f"{target}/v{number + 1}")
        for old in held[:-keep] if keep else []:
            where = session.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/v{old}")
            where.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


class Tickets:
    """Tickets that can be used once within their time to live, as a function for applyInPandasWithState.

    Input rows have (ticket, kind, ts): kind is issue or redeem, ts the event time in seconds. Every redeem yields (ticket, ts, ok).
    Run it with EventTimeTimeout on a stream with a watermark on the same clock: a ticket that nobody redeems leaves the state when the watermark is past its time to live.
    """

    output = "ticket string, ts double, ok boolean"
    state = "issued double"

    def __init__(self, ttl: float):
        self.ttl = ttl

    def __call__(self, key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        issued = state.get[0] if state.exists else None
        out = []
        # a ticket's few events of one micro-batch may come in several frames, in any order
        for ts, kind in sorted(row for frame in frames for row in frame[["ts", "kind"]].itertuples(index=False, name=None)):
            if kind == "issue":
                issued = ts
            else:
                out.append((key[0], ts, issued is not None and ts - issued <= self.ttl))
                issued = None
        if issued is not None:
            state.update((issued,))
            state.setTimeoutTimestamp(max(int((issued + self.ttl) * 1000), state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["ticket", "ts", "ok"])
