"""Stateful streams over several files of events: long traces, the ingest queue, watch triggers."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import functions as F

from opsframe.functions import cron
from opsframe.operators import lines
from opsframe.sources.tables import micros, read
from opsframe.storage import shared_folder
from opsframe.streaming import stateful

from .q_signals import _MARK, DAY, H, ended, stream
from .registry import query


def sent_unless_hashed(key: tuple, batch: int, attempt: int, rows: list) -> bool:
    """A sink that fails for a part of the attempts, always the same ones."""
    return zlib.crc32(f"{key[0]}/{batch}/{attempt}".encode()) % 3 > 0


@query("w5_long_traces_stream", f"""WITH s AS (SELECT user_id % 300 AS trace_id, epoch_us(ts) AS t, value > 350 AS bad, min(epoch_us(ts)) OVER (PARTITION BY user_id % 300) AS first FROM events)
SELECT trace_id, count(*) AS n, max(t) AS last FROM s GROUP BY trace_id, first HAVING NOT bool_or(bad AND t <= first + {DAY}) AND first + {DAY} < {_MARK} AND max(t) <= {_MARK} - 1000000""")
def w5_long(spark, sf):
    d = stream(spark, sf).where("not late").select((F.col("user_id") % 300).alias("trace_id"), "ts", "event_id", (F.col("value") > 350).alias("sdk"))
    out = ended(stateful.tail_sample(d, "sdk", wait="1 day", remember="60 days", order=["event_id"]), spark, "w5")
    # spans that the watermark has not passed by a second are still to come
    seen = spark.read.parquet(f"{sf}/events.parquet").groupBy((F.col("user_id") % 300).alias("trace_id")).agg(F.max(micros("ts")).alias("last"))
    mark = seen.agg(F.expr("max(last) div 1000 * 1000 - 120000000 - 1000000").alias("mark"))
    whole = seen.join(F.broadcast(mark), F.col("last") <= F.col("mark"), "left_semi")
    return out.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).join(whole, "trace_id")


@query("w15_flush_stream", f"""WITH RECURSIVE e AS (SELECT event_type, epoch_us(ts) AS t FROM events), b AS (SELECT event_type, min(t) AS start, 1 AS batch FROM e GROUP BY event_type
UNION ALL SELECT b.event_type, min(e.t), b.batch + 1 FROM b JOIN e ON e.event_type = b.event_type AND e.t >= b.start + {DAY} GROUP BY b.event_type, b.batch)
SELECT b.event_type, batch::BIGINT AS batch, start, count(*) AS n FROM b JOIN e ON e.event_type = b.event_type AND e.t >= start AND e.t < start + {DAY} WHERE start + {DAY} < {_MARK} GROUP BY ALL""")
def w15_flush(spark, sf):
    d = stream(spark, sf).where("not late").select("event_type", "event_id", "ts")
    out = ended(stateful.ingest_queue(d, ["event_type"], 1 << 20, "1 day", 1 << 21, [], lambda *x: True, order=["event_id"]), spark, "w15")
    return out.groupBy("event_type", "batch").agg(F.min(micros("ts")).alias("start"), F.count(F.lit(1)).alias("n"))


@query("w15_ingest_queue_stream")
def w15(spark, sf):
    d = stream(spark, sf).where("not late").select("event_type", "event_id", "ts")
    out = ended(stateful.ingest_queue(d, ["event_type"], 20, "3 hours", 40, ["1 hour", "6 hours", "12 hours"], sent_unless_hashed, order=["event_id"]), spark, "w15")
    return out.select("event_type", "event_id", micros("ts").alias("t"), "batch", "attempts", "outcome", micros("at").alias("at"))


@query("w11_watch_triggers_stream", f"""WITH c AS (SELECT event_type, epoch_us(ts) AS t, event_id, 'k' || user_id % 3 AS kind, 'o' || user_id % 50 AS object, CASE WHEN value > 300 THEN 'resync' WHEN value < 60 THEN 'delete' ELSE 'upsert' END AS op FROM events),
o AS (SELECT *, CASE WHEN t < lag(t) OVER q + {H // 2} THEN 0 ELSE 1 END AS new FROM c WINDOW q AS (PARTITION BY event_type ORDER BY t, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY t, event_id) AS k FROM o),
g AS (SELECT event_type, k, min(t) AS start, max(t) + {H // 2} AS ends, count(*) AS n, bool_or(op = 'resync') AS whole, max(event_id) AS version FROM s GROUP BY ALL),
d AS (SELECT event_type, k, kind, object, arg_max(op, row(t, event_id)) AS op, max(event_id) AS object_version FROM s GROUP BY ALL)
SELECT g.event_type, start, ends, n, CASE WHEN whole THEN 'full' ELSE 'delta' END AS sync, version::VARCHAR AS version, d.kind, d.object, d.op, d.object_version::VARCHAR AS object_version
FROM g LEFT JOIN d ON d.event_type = g.event_type AND d.k = g.k AND NOT whole WHERE ends < {_MARK}""")
def w11_watch(spark, sf):
    op = F.when(F.col("value") > 300, "resync").when(F.col("value") < 60, "delete").otherwise("upsert")
    named = lambda k, n: F.concat(F.lit(k), (F.col("user_id") % n).cast("string"))
    d = stream(spark, sf).where("not late").select("event_type", "ts", "event_id", named("k", 3).alias("kind"), named("o", 50).alias("object"), op.alias("op"), F.col("event_id").cast("string").alias("version"))
    out = ended(stateful.watch_triggers(d, ["event_type"], "30 minutes", None, order=["event_id"]), spark, "w11")
    return out.withColumn("start", micros("start")).withColumn("ends", micros("ends"))


_LINE = "CASE WHEN value > 80 THEN 'START ' ELSE '  at ' END || event_id || ' ' || event_type"


@query("s24_multi_line_records", f"""WITH l AS (SELECT event_type, event_id, {_LINE} AS line, sum(CASE WHEN value > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events),
g AS (SELECT event_type, r, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY event_id)) AS message FROM l GROUP BY ALL) SELECT event_type, r - min(r) OVER (PARTITION BY event_type) AS record, n, message FROM g""")
def s24_records(spark, sf):
    path = f"{shared_folder(spark)}/opsframe-{uuid.uuid4().hex}/text"
    head = F.when(F.col("value") > 80, "START ").otherwise("  at ")
    e = read(spark, sf, "events").select("event_type", "event_id", F.concat(head, F.col("event_id").cast("string"), F.lit(" "), "event_type").alias("value"))
    # a file a type, its lines in order
    e.repartitionByRange(16, "event_type").sortWithinPartitions("event_type", "event_id").select("event_type", "value").write.partitionBy("event_type").text(path)
    out = lines.records(lines.read_lines(spark, f"{path}/event_type=*"), start="^START ")
    return out.select(F.regexp_extract("file", "event_type=([^/]*)/", 1).alias("event_type"), "record", F.col("n").cast("long").alias("n"), F.md5("message").alias("message"))


@query("s24_record_stream", f"""WITH l AS (SELECT event_type, epoch_us(ts) AS t, event_id, {_LINE} AS line, CASE WHEN value > 80 OR lag(ts) OVER q IS NULL OR epoch_us(ts) >= epoch_us(lag(ts) OVER q) + {H} THEN 1 ELSE 0 END AS new FROM events WINDOW q AS (PARTITION BY event_type ORDER BY ts, event_id)),
k AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY t, event_id) AS r FROM l), g AS (SELECT event_type, r, min(t) AS start, max(t) AS last, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY t, event_id)) AS message FROM k GROUP BY ALL),
x AS (SELECT *, lead(start) OVER (PARTITION BY event_type ORDER BY r) AS next FROM g) SELECT event_type, start, n, message FROM x WHERE least(coalesce(next, last + {H}), last + {H}) < {_MARK}""")
def s24_stream(spark, sf):
    head = F.when(F.col("value") > 80, "START ").otherwise("  at ")
    d = stream(spark, sf).where("not late").select("event_type", "ts", "event_id", F.concat(head, F.col("event_id").cast("string"), F.lit(" "), "event_type").alias("line"))
    out = ended(lines.record_stream(d, ["event_type"], start="^START ", flush="1 hour", order=["event_id"]), spark, "s24")
    return out.select("event_type", micros("ts").alias("start"), "n", F.md5("message").alias("message"))


#: Schedules with what their fields mean: hours, minutes, months, days of the month and of the week, whether either day will do.
_SPECS = [
    ("*/20 8-17/3 * * mon-fri", "[8, 11, 14, 17]", "[0, 20, 40]", "range(1, 13)", "range(1, 32)", "[1, 2, 3, 4, 5]", False),
    ("0 9 1,15 * 5", "[9]", "[0]", "range(1, 13)", "[1, 15]", "[5]", True), ("30 23 29 FEB *", "[23]", "[30]", "[2]", "[29]", "range(0, 7)", False),
    ("@monthly", "[0]", "[0]", "range(1, 13)", "[1]", "range(0, 7)", False), ("15 6 31 4 *", "[6]", "[15]", "[4]", "[31]", "range(0, 7)", False), ("61 * * * *", "[]", "[]", "[]", "[]", "[]", False),
]


@query("fn_cron_next", f"""WITH s AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{x[0]}', {x[1]}::INT[], {x[2]}::INT[], {x[3]}::INT[], {x[4]}::INT[], {x[5]}::INT[], {x[6]})" for i, x in enumerate(_SPECS))}) v(k, spec, hours, minutes, months, doms, dows, either)),
c AS (SELECT k, d, h * 60 + m AS slot FROM s, (SELECT unnest(range(DATE '2023-12-01', DATE '2029-12-31', INTERVAL 1 DAY)) AS d), (SELECT unnest(range(0, 24)) AS h), (SELECT unnest(range(0, 60)) AS m)
 WHERE list_contains(months, month(d)) AND list_contains(hours, h) AND list_contains(minutes, m) AND CASE WHEN either THEN list_contains(doms, day(d)) OR list_contains(dows, dayofweek(d)) ELSE list_contains(doms, day(d)) AND list_contains(dows, dayofweek(d)) END),
f AS (SELECT k, epoch_us(d) + slot * 60000000 AS t FROM c), e AS (SELECT event_id, user_id % 6 AS k, epoch_us(ts) AS t FROM events)
SELECT event_id, spec, f.t AS next FROM e JOIN s USING (k) ASOF LEFT JOIN f ON e.k = f.k AND e.t < f.t""")
def fn_cron(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.get(F.array(*[F.lit(x[0]) for x in _SPECS]), (F.col("user_id") % 6).cast("int")).alias("spec"), micros("ts").alias("t"))
    return cron.next_fires(e, F.col("spec"), F.col("t")).select("event_id", "spec", "next")
