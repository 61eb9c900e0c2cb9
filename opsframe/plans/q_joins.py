"""Relational joins and relational aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.operators import interval as iv
from opsframe.sources.tables import micros, read
from opsframe.sources.upsert import delete_keys

from .registry import query

MIN = 60_000_000


@query("j7_inner_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000")
def j7(spark, sf):
    o, c, n = (read(spark, sf, t) for t in ("orders", "customer", "nation"))
    return o.where("o_totalprice > 300000").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("j8_left_outer_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j8(spark, sf):
    # orders are counted before the join, so that only a row per customer meets it
    n = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return read(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["n"])


@query("j9_anti_join", "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def j9(spark, sf):
    return read(spark, sf, "customer").select("c_custkey").join(read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("j10_semi_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000)")
def j10(spark, sf):
    o = read(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey", "left_semi")


@query("j11_not_exists", "SELECT s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey = s.s_suppkey AND o_totalprice > 400000)")
def j11(spark, sf):
    live = read(spark, sf, "lineitem").join(read(spark, sf, "orders").where("o_totalprice > 400000"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("s_suppkey"))
    return read(spark, sf, "supplier").select("s_suppkey").join(live, "s_suppkey", "left_anti")


@query("j12_exists_or", "SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = p.p_partkey OR (s.s_nationkey = p.p_size AND s.s_acctbal < 0))")
def j12(spark, sf):
    p, s = read(spark, sf, "part").select("p_partkey", "p_size"), read(spark, sf, "supplier")
    # two equi-joins instead of one nested loop over an OR
    a = p.join(s.select(F.col("s_suppkey").alias("p_partkey")), "p_partkey", "left_semi")
    b = p.join(s.where("s_acctbal < 0").select(F.col("s_nationkey").alias("p_size")), "p_size", "left_semi").select("p_partkey", "p_size")
    return a.unionByName(b).select("p_partkey").distinct()


@query("j13_interval_join", f"SELECT i.event_id AS incident, e.event_type, count(*) AS n FROM events i JOIN events e ON e.ts BETWEEN i.ts - INTERVAL 30 MINUTE AND i.ts + INTERVAL 30 MINUTE AND e.event_type <> 'error' WHERE i.event_type = 'error' GROUP BY ALL")
def j13(spark, sf):
    e = read(spark, sf, "events").select("event_id", "event_type", micros("ts").alias("t"))
    inc = e.where("event_type = 'error'").select(F.col("event_id").alias("incident"), (F.col("t") - 30 * MIN).alias("lo"), (F.col("t") + 30 * MIN).alias("hi"))
    return iv.interval_counts(inc, e.where("event_type <> 'error'"), ["incident"], "lo", "hi", "t", ["event_type"], 240 * MIN)


@query("j14_null_safe_neighbourhood", """WITH e AS (SELECT *, nullif(user_id, 7) AS device FROM events WHERE event_type IN ('error', 'signup'))
SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.device IS NOT DISTINCT FROM b.device AND b.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts + INTERVAL 2 HOUR AND a.event_id <> b.event_id WHERE a.event_type = 'error'""")
def j14(spark, sf):
    e = read(spark, sf, "events").where(F.col("event_type").isin("error", "signup")).select("event_id", "event_type", F.nullif("user_id", F.lit(7)).alias("device"), micros("ts").alias("t"))
    a = e.where("event_type = 'error'").select(F.col("event_id").alias("a"), "device", (F.col("t") - 120 * MIN).alias("lo"), (F.col("t") + 120 * MIN).alias("hi"))
    return iv.interval_join(a, e.select(F.col("event_id").alias("b"), "device", "t"), "lo", "hi", "t", 240 * MIN, ["device"]).where("a <> b").select("a", "b")


@query("j15_as_of_join", """SELECT a.event_id, b.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'error') a
LEFT JOIN LATERAL (SELECT event_id FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 2 DAY ORDER BY b.ts DESC LIMIT 1) b ON true""")
def j15(spark, sf):
    e = read(spark, sf, "events").select("event_id", "event_type", "user_id", micros("ts").alias("t"))
    left = e.where("event_type = 'error'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'view'").select("user_id", "t", F.col("event_id").alias("before"))
    return iv.as_of(left, right, ["user_id"], "t", ["before"], within=2 * 1440 * MIN).select("event_id", "before")


@query("j17_outer_merge_pivot", "SELECT date_trunc('day', ts) AS day, round(sum(value) FILTER (event_type = 'view'), 4) AS view, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'error'), 4) AS error FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1")
def j17(spark, sf):
    kinds = ["view", "click", "error"]
    p = read(spark, sf, "events").where(F.col("event_type").isin(kinds)).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).pivot("event_type", kinds).agg(F.sum("value"))
    return p.select("day", *[F.round(k, 4).alias(k) for k in kinds])


@query("j18_fill_in_merge", "SELECT k, max(kind) AS kind FROM (SELECT c_nationkey AS k, 'native' AS kind FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey, 'derived' FROM supplier) GROUP BY k")
def j18(spark, sf):
    native = read(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct().withColumn("kind", F.lit("native"))
    derived = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).distinct().withColumn("kind", F.lit("derived"))
    return native.unionByName(derived.join(native.select("k"), "k", "left_anti"))


@query("j20_silence_match", """WITH s AS (SELECT * FROM (VALUES (1, 'error', NULL::BIGINT), (2, NULL, 3), (3, 'view', 5), (4, 'none', NULL)) v(silence, kind, host))
SELECT event_id, min(silence) AS silence FROM events, s WHERE (s.kind IS NULL OR s.kind = event_type) AND (s.host IS NULL OR s.host = user_id) GROUP BY event_id""")
def j20(spark, sf):
    s = spark.createDataFrame([(1, "error", None), (2, None, 3), (3, "view", 5), (4, "none", None)], "silence int, kind string, host long")
    return iv.wildcard_match(read(spark, sf, "events"), s, {"kind": "event_type", "host": "user_id"}).groupBy("event_id").agg(F.min("silence").alias("silence"))


@query("j21_channel_routing", """WITH r AS (SELECT event_id, event_type, CASE WHEN user_id % 10 = 0 THEN [9] WHEN user_id % 10 = 1 THEN [7, 9] ELSE [] END AS pinned FROM events),
c AS (SELECT * FROM (VALUES (1, 'error'), (2, 'error'), (3, 'signup')) v(channel, kind)),
m AS (SELECT kind, list_sort(list(channel)) AS matched FROM c GROUP BY kind)
SELECT event_id, unnest(CASE WHEN len(pinned) > 0 THEN pinned ELSE coalesce(matched, [0]) END) AS channel FROM r LEFT JOIN m ON kind = event_type""")
def j21(spark, sf):
    u = F.col("user_id") % 10
    pinned = F.when(u == 0, F.array(F.lit(9))).when(u == 1, F.array(F.lit(7), F.lit(9))).otherwise(F.array().cast("array<int>"))
    r = read(spark, sf, "events").select("event_id", "event_type", pinned.alias("pinned"))
    c = spark.createDataFrame([(1, "error"), (2, "error"), (3, "signup")], "channel int, event_type string").groupBy("event_type").agg(F.array_sort(F.collect_list("channel")).alias("matched"))
    chosen = F.when(F.size("pinned") > 0, F.col("pinned")).otherwise(F.coalesce("matched", F.array(F.lit(0))))
    return r.join(c, "event_type", "left").select("event_id", F.explode(chosen).alias("channel"))


@query("j22_inhibition", """WITH f AS (SELECT user_id, event_type, min(event_id) AS id FROM events WHERE value > 200 GROUP BY ALL)
SELECT a.id, EXISTS (SELECT 1 FROM f b WHERE b.event_type = 'error' AND b.user_id = a.user_id AND a.event_type <> 'error') AS inhibited FROM f a""")
def j22(spark, sf):
    f = read(spark, sf, "events").where("value > 200").groupBy("user_id", "event_type").agg(F.min("event_id").alias("id"))
    root = f.where("event_type = 'error'").select("user_id", F.lit(True).alias("root"))
    return f.join(root, "user_id", "left").select("id", (F.coalesce("root", F.lit(False)) & (F.col("event_type") != "error")).alias("inhibited"))


@query("j23_mirror_pruning", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def j23(spark, sf):
    keep = read(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    stale = read(spark, sf, "supplier").select("s_suppkey").join(keep, "s_suppkey", "left_anti")
    return delete_keys(read(spark, sf, "supplier").select("s_suppkey"), stale, ["s_suppkey"])


@query("j24_parent_self_join", "SELECT c.conv_id, c.turn, p.turn IS NULL AND c.turn > 0 AS missing_parent FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def j24(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("has"))
    return c.join(p, ["conv_id", "turn"], "left").select("conv_id", "turn", (F.col("has").isNull() & (F.col("turn") > 0)).alias("missing_parent"))


@query("j25_hydration", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (1, 2, 3, 500, 1000)")
def j25(spark, sf):
    o = read(spark, sf, "orders").where(F.col("o_orderkey").isin(1, 2, 3, 500, 1000))
    return o.join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")
