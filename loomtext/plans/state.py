"""Job queues, schedulers, cooldowns and event buffers in their batch form; events and orders play the logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.merge import unseen
from ..sources.tables import table
from ..streaming import jobs as J
from .registry import query


@query("claimed_jobs", "SELECT o_orderpriority AS queue, o_orderkey AS job FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS o_orderdate) FROM orders) WHERE o_orderstatus = 'O' AND (o_orderdate IS NULL OR o_orderdate <= TIMESTAMP '2001-01-01') QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate NULLS LAST, o_orderkey) = 1")
def claimed(spark, d):
    """The next available job of every queue; every eleventh may start at any time."""
    o = table(spark, d, "orders").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")))
    jobs = o.where("o_orderstatus = 'O'").select(F.col("o_orderpriority").alias("queue"), F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("available_at"), F.col("o_orderkey").alias("created_at"))
    return J.claim(jobs, "queue", "job", F.lit("2001-01-01").cast("timestamp")).select("queue", "job")


@query("round_robin", "SELECT o_orderkey AS job, row_number() OVER (ORDER BY n, o_orderpriority) AS turn FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') WHERE n <= 20")
def round_robin(spark, d):
    """Twenty rounds over the queue types."""
    o = table(spark, d, "orders").where("o_orderstatus = 'O'")
    n = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    few = o.select("o_orderkey", "o_orderpriority", n.alias("n")).where("n <= 20")
    return few.select(F.col("o_orderkey").alias("job"), F.row_number().over(Window.orderBy("n", "o_orderpriority")).alias("turn"))


@query("stale_jobs", "SELECT user_id FROM events GROUP BY user_id HAVING max(ts) FILTER (WHERE event_type = 'click') < (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE OR max(ts) FILTER (WHERE event_type = 'click') IS NULL")
def stale_jobs(spark, d):
    """Users whose last heartbeat (a click) is older than five minutes before the newest event."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    beat = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("beat")).crossJoin(F.broadcast(now))  # one row
    return beat.where("beat is null or beat < now - interval 5 minutes").select("user_id")


@query("service_switches", "SELECT user_id, count(*) FILTER (WHERE event_type <> before) AS switches FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id")
def switches(spark, d):
    e = table(spark, d, "events").withColumn("before", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.groupBy("user_id").agg(F.count(F.when(F.col("event_type") != F.col("before"), 1)).alias("switches"))


@query("sticky_schedule", "SELECT user_id, count(DISTINCT event_type) - 1 AS switches FROM events GROUP BY user_id")
def sticky(spark, d):
    """Switches when each worker drains one service's queue before it changes to another."""
    return J.sticky_switches(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("service_schedule")
def service_schedule(spark, d):
    """Each user's events as requests: their turns if the worker drains a service before it changes."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), "event_type", F.lit(900).alias("takes"))
    return J.schedule(e, "user_id", "event_id", "at", "event_type", "takes", ["error", "signup", "click", "view", "purchase"])


@query("cooldown", """WITH RECURSIVE n AS (SELECT e.user_id, e.event_id, arg_min(f.event_id, (f.ts, f.event_id)) AS following FROM events e LEFT JOIN events f ON f.user_id = e.user_id AND f.ts >= e.ts + INTERVAL 600 SECOND GROUP BY 1, 2),
a AS (SELECT * FROM n WHERE event_id IN (SELECT arg_min(event_id, (ts, event_id)) FROM events GROUP BY user_id) UNION ALL SELECT n.* FROM a JOIN n ON n.event_id = a.following) SELECT user_id, event_id FROM a""")
def cooldown(spark, d):
    """Events that a cooldown of ten minutes per user lets through; an accepted one restarts the clock."""
    return J.cooldown(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "event_id", "ts", 600)


@query("capped_operations", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n <= 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 8")
def capped(spark, d):
    """Three operations per field and eight per proposal, in order."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    few = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))).where("n <= 3")
    return few.withColumn("m", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("m <= 8").select("user_id", "event_type", "event_id")


@query("enqueued", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 8) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '2001-06-01')")
def enqueued(spark, d):
    """Keys over the threshold without an active job and without a run inside the cooldown."""
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    ready = o.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 8").select("c_custkey")
    ready = unseen(ready, o.where("o_orderstatus = 'P'"), ["c_custkey"])
    recent = o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") > F.lit("2001-06-01").cast("timestamp")))
    return unseen(ready, recent, ["c_custkey"]).join(table(spark, d, "customer").select("c_custkey"), "c_custkey", "left_semi")


@query("translation_cache", "SELECT DISTINCT sha256(text) AS source_hash, 'm1' AS model, 'en' AS target FROM documents WHERE lang <> 'en' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0)")
def cache(spark, d):
    """Texts still to be translated: not in the cache by (hash, model, target)."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("source_hash"), F.lit("m1").alias("model"), F.lit("en").alias("target"))
    keys = ["source_hash", "model", "target"]
    return unseen(docs.where("lang <> 'en'"), docs.where("doc_id % 4 = 0"), keys).select(*keys).distinct()


@query("patched_documents")
def patched(spark, d):
    """Versioned documents after their patch log: append, set and remove on allowed fields, in version order."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("version"), F.element_at(F.array(*map(F.lit, ("append", "set", "remove"))), (F.col("event_id") % 3 + 1).cast("int")).alias("op"), F.col("event_type").alias("path"), F.col("value").cast("string").alias("value"))
    return J.apply_patches(e, "user_id", ["click", "view", "purchase", "error"])


@query("streamed_counts", "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY event_type")
def streamed(spark, d):
    """The event roll-up computed by a stream that reads all files once and stops."""
    return J.streamed_rollup(spark, f"{d}/events.parquet", table(spark, d, "events").schema)


@query("tumbling_windows", "SELECT CAST(time_bucket(INTERVAL 5 MINUTE, ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling(spark, d):
    w = table(spark, d, "events").groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
