"""Log search, paging, histograms; sorts, limits, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opsframe.operators import logs as lg
from opsframe.operators.select import LogRequest
from opsframe.sources.tables import LOGS_SQL, logs, micros, read
from opsframe.sources.upsert import latest

from .registry import query

DAY = 86_400_000_000
T0 = 1_704_067_200_000_000
R = dict(start=T0 + 2 * DAY, end=T0 + 9 * DAY)
RANGE = f"t >= {R['start']} AND t <= {R['end']}"


@query("s10_log_search", f"WITH {LOGS_SQL} SELECT * FROM logs WHERE {RANGE} AND service IN ('error') AND contains(lower(message), '1') ORDER BY t DESC, id DESC LIMIT 51")
def s10(spark, sf):
    return lg.search(logs(spark, sf), LogRequest(**R, scope={"service": ["error"]}, include=["1"], limit=50))


@query("o4_keyset_page", f"""WITH {LOGS_SQL}, d AS (SELECT * REPLACE (t // {DAY} * {DAY} AS t) FROM logs), p AS (SELECT * FROM d WHERE {RANGE} ORDER BY t, id LIMIT 80)
SELECT d.* FROM d, (SELECT arg_max(t, row(t, id)) AS ct, arg_max(id, row(t, id)) AS ci FROM p) WHERE {RANGE} AND (t > ct OR (t = ct AND id > ci)) ORDER BY t, id LIMIT 81""")
def o4(spark, sf):
    d = logs(spark, sf).withColumn("t", F.floor(F.col("t") / F.lit(DAY)).cast("long") * DAY)
    r = LogRequest(**R, limit=80, descending=False)
    _, cursor = lg.page(lg.search(d, r), r.limit)
    return lg.search(d, r, cursor or (r.end, 1 << 62))


@query("o5_search_after_descending", f"WITH {LOGS_SQL} SELECT * FROM logs WHERE {RANGE} ORDER BY t DESC, id DESC LIMIT 31 OFFSET 30")
def o5(spark, sf):
    r = LogRequest(**R, limit=30)
    _, cursor = lg.page(lg.search(logs(spark, sf), r), r.limit)
    return lg.search(logs(spark, sf), r, cursor or (0, 0))


@query("o6_query_all", f"WITH {LOGS_SQL} SELECT id, t FROM logs WHERE {RANGE} ORDER BY t DESC, id DESC LIMIT 5000")
def o6(spark, sf):
    return logs(spark, sf).where(LogRequest(**R).condition()).orderBy(F.desc("t"), F.desc("id")).select("id", "t").limit(5000)


@query("a13_grouped_log_count", f"WITH {LOGS_SQL} SELECT service, nullif(trim(severity_text), '') AS severity_text, count(*) AS n FROM logs WHERE t > {R['start']} AND t <= {R['end']} GROUP BY ALL")
def a13(spark, sf):
    return lg.count_by(logs(spark, sf), LogRequest(**R), ["service", "severity_text"])


@query("a13_log_count", f"WITH {LOGS_SQL} SELECT count(*) AS n FROM logs WHERE t > {R['start']} AND t <= {R['end']} AND contains(lower(message), 'view')")
def a13b(spark, sf):
    return lg.count_by(logs(spark, sf), LogRequest(**R, include=["view"]))


@query("a14_field_values", f"WITH {LOGS_SQL} SELECT host::VARCHAR AS value, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def a14(spark, sf):
    return lg.top_values(logs(spark, sf), "host", 20)


_S, _E, _I = T0 + 12_345_678, T0 + 5 * DAY + 777, 7_200_000_000


@query("l1_histogram", f"""WITH {LOGS_SQL}, axis AS (SELECT unnest(range(0, {-(-(_E - _S) // _I)})) AS k),
c AS (SELECT least((t - {_S}) // {_I}, {-(-(_E - _S) // _I) - 1}) AS k, count(*) AS n FROM logs WHERE t >= {_S} AND t <= {_E} GROUP BY 1)
SELECT axis.k * {_I} + {_S} AS bucket, coalesce(n, 0)::BIGINT AS n FROM axis LEFT JOIN c USING (k)""")
def l1(spark, sf):
    return lg.histogram(logs(spark, sf), _S, _E, _I)


@query("l3_record_id", f"WITH {LOGS_SQL} SELECT id, sha256(concat(length(t::VARCHAR), ':', t, length(service), ':', service, length(message), ':', message)) AS record FROM logs")
def l3(spark, sf):
    return logs(spark, sf).select("id", lg.record_id("t", "service", "message").alias("record"))


@query("j16_log_context", f"""WITH {LOGS_SQL} (SELECT id, t FROM logs WHERE service = 'error' AND t < {T0 + 6 * DAY} ORDER BY t DESC, id DESC LIMIT 50)
UNION ALL (SELECT id, t FROM logs WHERE service = 'error' AND t >= {T0 + 6 * DAY} ORDER BY t, id LIMIT 50)""")
def j16(spark, sf):
    return lg.context(logs(spark, sf), T0 + 6 * DAY, F.col("service") == "error").select("id", "t")


@query("n13_label_values", "SELECT 'lang' AS label, lang AS value FROM documents WHERE lang IS NOT NULL UNION SELECT 'source', source FROM documents WHERE source IS NOT NULL")
def n13(spark, sf):
    labels = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    return read(spark, sf, "documents").select(F.explode(labels).alias("label", "value")).where("value is not null").distinct()


# --- sorts, limits, paging ------------------------------------------------------------------------


@query("o1_rank_hosts", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def o1(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50)


@query("o2_nulls_last_sort", "SELECT s_suppkey, nullif(s_nationkey, 3) AS nation FROM supplier ORDER BY nation DESC NULLS LAST, s_suppkey LIMIT 60")
def o2(spark, sf):
    d = read(spark, sf, "supplier").select("s_suppkey", F.nullif("s_nationkey", F.lit(3)).alias("nation"))
    return d.orderBy(F.desc_nulls_last("nation"), "s_suppkey").limit(60)


@query("o3_offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100 OFFSET 200")
def o3(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").offset(200).limit(100)


@query("o7_coalesce_sort", "SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), o_orderstatus) AS k FROM orders ORDER BY k DESC, o_orderkey DESC LIMIT 40")
def o7(spark, sf):
    k = F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), "o_orderstatus")
    return read(spark, sf, "orders").select("o_orderkey", k.alias("k")).orderBy(F.desc("k"), F.desc("o_orderkey")).limit(40)


@query("o9_timeline", "SELECT event_id, epoch_us(ts) AS t FROM events ORDER BY ts, event_id LIMIT 5000")
def o9(spark, sf):
    return read(spark, sf, "events").select("event_id", micros("ts").alias("t")).orderBy("t", "event_id").limit(5000)


@query("o10_panel_caps", """SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(value) DESC, event_id) AS n FROM events) WHERE n <= 5""")
def o10(spark, sf):
    return latest_n(read(spark, sf, "events"), ["event_type"], [F.desc(F.abs("value")), F.asc("event_id")], 5).select("event_type", "event_id", "value")


def latest_n(d, keys, order, n):
    return d.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


@query("o11_budget_guard", "SELECT n_nationkey, n_name FROM nation")
def o11(spark, sf):
    return lg.bounded(read(spark, sf, "nation").select("n_nationkey", "n_name"), 5000)


# --- sets and de-duplication ----------------------------------------------------------------------


@query("u1_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u1(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("u2_union_all", "SELECT c_nationkey AS k, 'c' AS kind FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def u2(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("kind"))
    return c.unionByName(read(spark, sf, "supplier").select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("k")))


@query("u4_labelled_union", "SELECT event_type, count(*)::DOUBLE AS n, round(avg(value), 4) AS mean, max(value) AS top FROM events GROUP BY event_type")
def u4(spark, sf):
    e = read(spark, sf, "events")
    # one pass with several aggregates is the labelled union of three; the pivot stays for callers that need rows
    one = e.groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"))
    rows = one.unpivot("event_type", ["n", "mean", "top"], "stat", "v")
    p = rows.groupBy("event_type").pivot("stat", ["n", "mean", "top"]).agg(F.first("v"))
    return p.withColumn("mean", F.round("mean", 4))


@query("u5_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def u5(spark, sf):
    return read(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("u6_latest_wins", "SELECT user_id, arg_max(event_id, row(ts, event_id)) AS event_id, arg_max(event_type, row(ts, event_id)) AS event_type FROM events GROUP BY user_id")
def u6(spark, sf):
    return latest(read(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("u6_first_wins", "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def u6b(spark, sf):
    return latest(read(spark, sf, "events"), ["event_type"], [F.asc("event_id")]).select("event_type", "event_id")


@query("u7_head_chunk", """SELECT conv_id, arg_min(turn, row((turn <> 1)::INT, turn)) AS turn, count(*) AS chunks FROM conversations GROUP BY conv_id""")
def u7(spark, sf):
    order = F.struct((F.col("turn") != 1).cast("int").alias("a"), F.col("turn").alias("b"))
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("turn", order).alias("turn"), F.count(F.lit(1)).alias("chunks"))


@query("u8_collapse_by_parent", "SELECT label, arg_max(vec_id, row(embedding[1], -vec_id)) AS vec_id FROM embeddings GROUP BY label")
def u8(spark, sf):
    d = read(spark, sf, "embeddings").withColumn("score", F.get("embedding", F.lit(0)))
    return latest(d, ["label"], [F.desc("score"), F.asc("vec_id")]).select("label", "vec_id")


@query("u9_sorted_sets", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY user_id")
def u9(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("u10_idempotent_snapshot", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def u10(spark, sf):
    e = read(spark, sf, "events")
    return e.unionByName(e).dropDuplicates(["event_id"]).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
