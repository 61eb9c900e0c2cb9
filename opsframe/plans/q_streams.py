"""Streams run to their end over the event files; their SQL is that of the closed result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from opsframe.sources.tables import micros
from opsframe.storage import shared_folder
from opsframe.streaming import windows as w

from .registry import query

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
H, DAY = 3_600_000_000, 86_400_000_000


def events(spark, sf):
    d = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf)
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


def ended(stream, spark, name):
    """The stream's rows, with timestamps in microseconds; its state and output lie in the shared folder."""
    return w.run_to_end(stream, spark, f"{shared_folder(spark)}/opsframe-{uuid.uuid4().hex}", name)


_CLOSED = "(SELECT max(epoch_us(ts)) // 1000 * 1000 - 120000000 FROM events)"


@query("w1_tumbling_stream", f"SELECT event_type, epoch_us(ts) // {H} * {H} AS t, max(value) AS max, count(*) AS n FROM events GROUP BY ALL HAVING epoch_us(any_value(ts)) // {H} * {H} + {H} <= {_CLOSED}")
def w1(spark, sf):
    out = ended(w.tumbling(events(spark, sf), ["event_type"], "value", "1 hour"), spark, "w1")
    return out.select("event_type", micros("ts").alias("t"), "max", "n")


@query("w2_sliding_stream", f"WITH x AS (SELECT event_type, value, unnest([epoch_us(ts) // {H} * {H}, epoch_us(ts) // {H} * {H} - {H}]) AS t FROM events) SELECT event_type, t, max(value) AS max, count(*) AS n FROM x GROUP BY ALL HAVING t + {2 * H} <= {_CLOSED}")
def w2(spark, sf):
    out = ended(w.tumbling(events(spark, sf), ["event_type"], "value", "2 hours", "1 hour"), spark, "w2")
    return out.select("event_type", micros("ts").alias("t"), "max", "n")


@query("w7_span_metrics_stream", f"SELECT event_type, epoch_us(ts) // {H} * {H} AS t, count(*) AS calls, count(*) FILTER (value <= 50) AS le_50, count(*) FILTER (value <= 100) AS le_100 FROM events GROUP BY ALL HAVING epoch_us(any_value(ts)) // {H} * {H} + {H} <= {_CLOSED}")
def w7(spark, sf):
    d = events(spark, sf).withColumn("duration_ms", F.col("value"))
    out = ended(w.span_metrics(d, ["event_type"], [50, 100], size="1 hour"), spark, "w7")
    return out.select("event_type", micros("w.start").alias("t"), "calls", "le_50", "le_100")


@query("w9_once_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def w9(spark, sf):
    d = events(spark, sf)
    return ended(w.once(d.union(d), ["event_id"], "60 days"), spark, "w9").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("w10_alert_state_stream", f"""WITH f AS (SELECT event_type, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events WHERE value > 150)
SELECT event_type, t, CASE WHEN p IS NULL THEN 'opened' WHEN t - p <= {6 * H} THEN 'bumped' ELSE 'reopened' END AS event FROM f""")
def w10(spark, sf):
    f = events(spark, sf).where("value > 150").select("event_type", micros("ts").alias("t"))
    return ended(w.alert_state(f, ["event_type"], 6 * H, DAY), spark, "w10").where("event <> 'notified'")


@query("w12_counter_stream", "WITH p AS (SELECT event_type, epoch_us(ts) AS t, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS d FROM events) SELECT event_type, t, round(greatest(d, 0), 6) AS delta FROM p WHERE d IS NOT NULL")
def w12(spark, sf):
    d = events(spark, sf).select("event_type", micros("ts").alias("t"), "event_id", "value")
    return ended(w.counter_deltas(d, ["event_type"], ["event_id"]), spark, "w12").withColumn("delta", F.round("delta", 6))


@query("w8_service_graph_stream", """SELECT c.event_type AS client, coalesce(s.event_type, 'virtual_node') AS server, count(*) AS n FROM events c LEFT JOIN events s ON s.event_id = c.event_id + 1 AND s.event_type <> 'view' AND s.ts BETWEEN c.ts - INTERVAL 1 HOUR AND c.ts + INTERVAL 1 HOUR
WHERE c.event_type = 'view' AND s.event_id IS NOT NULL GROUP BY ALL""")
def w8(spark, sf):
    e = events(spark, sf)
    base = e.select(F.lit("t").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), (F.col("event_id") - 1).cast("string").alias("parent_span_id"), F.col("event_type").alias("service"), "ts", F.lit(False).alias("failed"))
    c = base.where("service = 'view'").select("trace_id", "span_id", "service", "ts", "failed")
    s = base.where("service <> 'view'").select("trace_id", "parent_span_id", "service", "ts", "failed")
    out = ended(w.service_graph(c, s, "1 hour"), spark, "w8")
    return out.where("server <> 'virtual_node'").groupBy("client", "server").agg(F.count(F.lit(1)).alias("n"))


@query("w5_tail_sampling", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING NOT bool_or(role = 'system')")
def w5(spark, sf):
    d = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("trace_id"), (F.col("role") == "system").alias("sdk"))
    return w.sampled(d, "sdk").groupBy(F.col("trace_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n"))
