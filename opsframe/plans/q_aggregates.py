"""Services, roll-ups, reports and other aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.operators import red, rollup
from opsframe.sources.tables import micros, read

from .q_range import T0
from .registry import query

DAY = 86_400_000_000


#: Latency bounds of the request counters in seconds, and the counter of all requests.
_BOUNDS = {"0.1": 0.1, "0.25": 0.25, "0.5": 0.5, "0.75": 0.75, "1": 1.0, "+Inf": 1e9, "count": 1e9}
_TEN = 600_000_000


def request_counters(lines, service: str):
    """Cumulative request counters of a service and protocol, by status and bound, a sample a minute over ten minutes, from order lines."""
    slot = (F.col("l_orderkey") + F.col("l_linenumber")) % 11
    les = F.filter(F.array(*[F.struct(F.lit(k).alias("le"), F.lit(v).alias("bound")) for k, v in _BOUNDS.items()]), lambda x: x["bound"] >= F.col("l_quantity") / 50)
    one = lines.select(F.col(service).cast("string").alias("service"), F.col("l_linestatus").alias("protocol"), F.when(F.col("l_returnflag") == "R", "500").otherwise("200").alias("status"), F.explode(les).alias("x"), slot.alias("slot"))
    counts = one.groupBy("service", "protocol", "status", F.col("x.le").alias("le"), "slot").count()
    grown = counts.withColumn("k", F.explode(F.sequence("slot", F.lit(10)))).groupBy("service", "protocol", "status", "le", "k").agg(F.sum("count").cast("double").alias("value"))
    return grown.select("service", "protocol", "status", "le", (F.col("k") * 60_000_000).alias("t"), "value")


def _red_sql(service: str, source: str) -> str:
    at = "round(1000 * arg_min(l0 + (le - l0) * CASE WHEN v > c0 THEN ({q} * n - c0) / (v - c0) ELSE 0 END, le) FILTER (v >= {q} * n - 1e-9), 4) AS {name}"
    return f"""WITH b AS (SELECT {service}::VARCHAR AS i, l_linestatus AS p, CASE WHEN l_returnflag = 'R' THEN '500' ELSE '200' END AS s, le, unnest(range((l_orderkey + l_linenumber) % 11, 11)) AS k FROM {source}, (VALUES {', '.join(f"('{k}', {v})" for k, v in _BOUNDS.items())}) y(le, bound) WHERE l_quantity / 50 <= bound),
c AS (SELECT i, p, s, le, k, count(*)::DOUBLE AS value FROM b GROUP BY ALL),
w AS (SELECT i, p, s, le, min(k) * 60.0::DOUBLE AS tf, arg_min(value, k) AS vf, max(value) - min(value) AS delta FROM c GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT i, p, s, le, delta * (600 - tf + CASE WHEN delta > 0 THEN least(CASE WHEN tf < 66 THEN tf ELSE 30 END, (600 - tf) * vf / delta) ELSE CASE WHEN tf < 66 THEN tf ELSE 30 END END) / (600 - tf) / 600 AS rate FROM w),
m AS (SELECT i, p, le, sum(rate) AS v, coalesce(sum(rate) FILTER (s = '500'), 0) AS bad FROM r GROUP BY ALL), h AS (SELECT i, p, CASE WHEN le = '+Inf' THEN 'inf' ELSE le END::DOUBLE AS le, v FROM m WHERE le <> 'count'),
g AS (SELECT *, coalesce(lag(le) OVER w, 0) AS l0, coalesce(lag(v) OVER w, 0) AS c0, last_value(v) OVER (PARTITION BY i, p ORDER BY le ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM h WINDOW w AS (PARTITION BY i, p ORDER BY le)),
q AS (SELECT i, p, {', '.join(at.format(q=q, name=n) for n, q in red.QUANTILES.items())} FROM g WHERE n > 0 GROUP BY i, p)
SELECT m.i AS service, m.p AS protocol, round(v, 4) AS rps, round(bad / nullif(v, 0), 4) AS error_rate, p50, p95, p99 FROM m LEFT JOIN q ON m.i = q.i AND m.p = q.p WHERE le = 'count'"""


def _red(lines, service: str):
    out = red.summarise(request_counters(lines, service), ["service", "protocol"], _TEN, _TEN)
    return out.select("service", "protocol", *[F.round(c, 4).alias(c) for c in ("rps", "error_rate", "p50", "p95", "p99")])


@query("a6_red_benchmark_table", _red_sql("s_nationkey", "lineitem JOIN supplier ON l_suppkey = s_suppkey"))
def a6(spark, sf):
    lines = read(spark, sf, "lineitem")
    return _red(lines.join(read(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), lines.l_suppkey == F.col("s_suppkey")), "s_nationkey")


@query("a6_red_thousand_services", _red_sql("l_suppkey", "lineitem"))
def a6_thousand(spark, sf):
    return _red(read(spark, sf, "lineitem"), "l_suppkey")


_SVC = "SELECT event_type AS service, user_id % 3 AS protocol, value AS ms, value > 200 AS bad FROM events"


@query("a7_red_summary", f"WITH s AS ({_SVC}) SELECT service, protocol, count(*) AS n, round(avg(bad::INT), 6) AS error_rate, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.95), 4) AS p95, round(quantile_cont(ms, 0.99), 4) AS p99 FROM s GROUP BY ALL")
def a7(spark, sf):
    s = read(spark, sf, "events").select(F.col("event_type").alias("service"), (F.col("user_id") % 3).alias("protocol"), F.col("value").alias("ms"), (F.col("value") > 200).cast("int").alias("bad"))
    return s.groupBy("service", "protocol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("bad"), 6).alias("error_rate"), *[F.round(F.percentile("ms", q), 4).alias(n) for n, q in red.QUANTILES.items()])


@query("a8_default_zero_ratio", "SELECT l_suppkey, round(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) / nullif(sum(l_quantity), 0), 6) AS ratio FROM lineitem GROUP BY l_suppkey")
def a8(spark, sf):
    q = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("e"), F.sum("l_quantity").alias("n"))
    return q.select("l_suppkey", F.round(F.coalesce("e", F.lit(0.0)) / F.nullif(F.col("n"), F.lit(0.0)), 6).alias("ratio"))


@query("a9_protocol_combine", f"""WITH s AS ({_SVC}), p AS (SELECT service, protocol, CASE WHEN service = 'view' AND protocol = 1 THEN NULL ELSE count(*) END AS rps, avg(bad::INT) AS e FROM s GROUP BY service, protocol)
SELECT service, CASE WHEN count(rps) = count(*) THEN sum(rps)::DOUBLE END AS rps, round(CASE WHEN count(rps) = count(*) THEN sum(rps * e) / nullif(sum(rps), 0) END, 6) AS error_rate FROM p GROUP BY service""")
def a9(spark, sf):
    s = read(spark, sf, "events").select(F.col("event_type").alias("service"), (F.col("user_id") % 3).alias("protocol"), (F.col("value") > 200).cast("int").alias("bad"))
    p = s.groupBy("service", "protocol").agg(F.count(F.lit(1)).cast("double").alias("rps"), F.avg("bad").alias("error_rate"))
    p = p.withColumn("rps", F.when(~((F.col("service") == "view") & (F.col("protocol") == 1)), F.col("rps"))).withColumns({q: F.lit(None).cast("double") for q in red.QUANTILES})
    return red.combine(p, ["service"]).select("service", "rps", F.round("error_rate", 6).alias("error_rate"))


@query("a10_dependency_edges", """WITH c AS (SELECT sn.n_name AS client, cn.n_name AS server, l_returnflag AS kind, (l_discount > 0.05) AS error, l_quantity AS duration FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
JOIN customer ON o_custkey = c_custkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey)
SELECT client, server, kind, count(*) AS n, round(avg(error::INT), 6) AS error_rate, round(quantile_cont(duration, 0.95), 4) AS p95 FROM c WHERE client <> server GROUP BY ALL ORDER BY n DESC, client, server, kind LIMIT 200""")
def a10(spark, sf):
    l, o, s, c, n = (read(spark, sf, t) for t in ("lineitem", "orders", "supplier", "customer", "nation"))
    calls = l.join(o, l.l_orderkey == o.o_orderkey).join(s, l.l_suppkey == s.s_suppkey).join(c, o.o_custkey == c.c_custkey)
    calls = calls.join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("client")), "s_nationkey").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("server")), "c_nationkey")
    calls = calls.select("client", "server", F.col("l_returnflag").alias("kind"), (F.col("l_discount") > 0.05).cast("int").alias("error"), F.col("l_quantity").alias("duration"))
    out = red.dependencies(calls, "client", "server", ["kind"])
    return out.select("client", "server", "kind", "n", F.round("error_rate", 6).alias("error_rate"), F.round("p95", 4).alias("p95"))


@query("a11_error_groups", """SELECT event_type AS fingerprint, count(*) AS n, min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last, arg_max(event_id, row(ts, event_id)) AS sample, array_to_string(list_sort(list(DISTINCT (user_id % 7)::VARCHAR)), ',') AS versions FROM events WHERE value > 100 GROUP BY event_type""")
def a11(spark, sf):
    e = read(spark, sf, "events").where("value > 100").withColumn("t", micros("ts"))
    versions = F.array_join(F.array_sort(F.collect_set((F.col("user_id") % 7).cast("string"))), ",")
    return e.groupBy(F.col("event_type").alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.max_by("event_id", F.struct("t", "event_id")).alias("sample"), versions.alias("versions"))


@query("a12_instance_coalescing", "SELECT c_nationkey, arg_min(c_mktsegment, c_custkey) FILTER (c_mktsegment <> 'MACHINERY') AS version, arg_min(c_name, c_custkey) FILTER (c_acctbal > 0) AS host FROM customer GROUP BY c_nationkey")
def a12(spark, sf):
    c = read(spark, sf, "customer")
    first = lambda v, cond: F.min_by(F.when(cond, F.col(v)), F.when(cond, F.col("c_custkey")))
    return c.groupBy("c_nationkey").agg(first("c_mktsegment", F.col("c_mktsegment") != "MACHINERY").alias("version"), first("c_name", F.col("c_acctbal") > 0).alias("host"))


@query("a15_metric_catalog", """WITH s AS (SELECT event_type AS name, count(DISTINCT user_id) AS series, list_slice(list_sort(list(DISTINCT user_id)), 1, 3) AS x FROM events GROUP BY event_type)
SELECT name, series, array_to_string(list_transform(x, lambda v: '{"host":"' || v || '"}'), ' ') AS labels, 3 * contains(name, 'err')::INT + 2 * contains(name, 'r')::INT AS score FROM s""")
def a15(spark, sf):
    s = read(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.array_sort(F.collect_set("user_id")).alias("x"))
    labels = F.transform(F.slice("x", 1, 3), lambda v: F.to_json(F.create_map(F.lit("host"), v.cast("string"))))
    score = 3 * F.col("name").contains("err").cast("int") + 2 * F.col("name").contains("r").cast("int")
    return s.select("name", F.size("x").cast("long").alias("series"), F.array_join(labels, " ").alias("labels"), score.alias("score"))


_FIVE = "SELECT user_id AS host, epoch_us(ts) // 300000000 * 300000000 AS ts, avg(value) AS cpu_avg, max(value) AS cpu_max, sum(event_id) AS rx_sum, count(*) AS n FROM events GROUP BY ALL"


def five(spark, sf):
    p = read(spark, sf, "events").select(F.col("user_id").alias("host"), F.col("value").alias("cpu"), F.col("event_id").alias("rx"), F.lit(1).alias("n"), micros("ts").alias("t"))
    return rollup.to_five_minutes(p, ["host"], ["cpu"], ["rx", "n"])


@query("a16_five_minute_rollup", f"SELECT host, ts, round(cpu_avg, 6) AS cpu_avg, cpu_max, rx_sum::BIGINT AS rx_sum FROM ({_FIVE})")
def a16(spark, sf):
    return five(spark, sf).select("host", "ts", F.round("cpu_avg", 6).alias("cpu_avg"), "cpu_max", "rx_sum")


@query("a17_hour_rollup", f"SELECT host, ts // 3600000000 * 3600000000 AS ts, round(avg(cpu_avg), 6) AS cpu_avg, max(cpu_max) AS cpu_max, sum(rx_sum)::BIGINT AS rx_sum FROM ({_FIVE}) GROUP BY ALL")
def a17(spark, sf):
    return rollup.to_hours(five(spark, sf), ["host"], ["cpu"], ["rx"]).select("host", "ts", F.round("cpu_avg", 6).alias("cpu_avg"), "cpu_max", "rx_sum")


@query("a17_hour_rollup_weighted", f"SELECT host, ts // 3600000000 * 3600000000 AS ts, round(sum(cpu_avg * n) / sum(n), 6) AS cpu_avg FROM ({_FIVE}) GROUP BY ALL")
def a17w(spark, sf):
    return rollup.to_hours(five(spark, sf), ["host"], ["cpu"], ["rx"], weights="n_sum").select("host", "ts", F.round("cpu_avg", 6).alias("cpu_avg"))


@query("a18_sql_aggregates", "SELECT o_orderstatus, count(*) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total, max(o_orderdate) AS last FROM orders GROUP BY o_orderstatus")
def a18(spark, sf):
    return read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"), F.max("o_orderdate").alias("last"))


@query("a19_conditional_zero_filled", "WITH ids AS (SELECT unnest([0, 1, 2, 3, 999]) AS id) SELECT id, coalesce(sum((o_orderstatus = 'F')::INT), 0)::BIGINT AS failed, coalesce(sum((o_orderstatus = 'O')::INT), 0)::BIGINT AS open FROM ids LEFT JOIN orders ON o_custkey = id GROUP BY id")
def a19(spark, sf):
    ids = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 999)], "id int")
    n = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    return ids.join(n, ids.id == n.o_custkey, "left").select("id", F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("open", F.lit(0)).alias("open"))


@query("a20_two_key_rollup", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1")
def a20(spark, sf):
    return read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))


@query("a21_namespace_summary", """WITH u AS (SELECT c_nationkey AS ns, 1 AS c, 0 AS s, c_custkey AS seen FROM customer UNION ALL SELECT s_nationkey, 0, 1, s_suppkey FROM supplier UNION ALL SELECT coalesce(NULL, n_nationkey), 0, 0, n_regionkey FROM nation)
SELECT ns, sum(c)::BIGINT AS customers, sum(s)::BIGINT AS suppliers, max(seen) AS last FROM u GROUP BY ns""")
def a21(spark, sf):
    # each part is counted before the union, so three rows a namespace are shuffled instead of all
    part = lambda t, ns, seen, c, s: read(spark, sf, t).groupBy(F.col(ns).alias("ns")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col(seen).cast("long")).alias("seen")).select("ns", (F.col("n") * c).alias("c"), (F.col("n") * s).alias("s"), "seen")
    u = part("customer", "c_nationkey", "c_custkey", 1, 0).unionByName(part("supplier", "s_nationkey", "s_suppkey", 0, 1)).unionByName(part("nation", "n_nationkey", "n_regionkey", 0, 0))
    return u.groupBy("ns").agg(F.sum("c").alias("customers"), F.sum("s").alias("suppliers"), F.max("seen").alias("last"))


@query("a22_count_over_union", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
def a22(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).unionAll(read(spark, sf, "supplier").select("s_nationkey")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("a23_bounded_count", "SELECT count(*) AS n FROM (SELECT 1 FROM events WHERE event_type = 'error' LIMIT 100)")
def a23(spark, sf):
    return read(spark, sf, "events").where("event_type = 'error'").select("event_id").limit(100).agg(F.count(F.lit(1)).alias("n"))


@query("a24_session_counts", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id")
def a24(spark, sf):
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


@query("a30_packet_flows", """WITH p AS (SELECT least(user_id, event_id % 40) AS a, greatest(user_id, event_id % 40) AS b, event_type AS edge, epoch_us(ts) AS t FROM events)
SELECT a, b, count(*) AS n, min(t) AS first, max(t) AS last, array_to_string(list_sort(list(DISTINCT edge)), ',') AS seen_by, array_to_string(list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(list(DISTINCT edge), x))), ',') AS missing FROM p GROUP BY a, b""")
def a30(spark, sf):
    u, v = F.col("user_id"), F.col("event_id") % 40
    p = read(spark, sf, "events").select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b"), F.col("event_type").alias("edge"), micros("ts").alias("t"))
    everywhere = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    g = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.array_sort(F.collect_set("edge")).alias("s"))
    return g.select("a", "b", "n", "first", "last", F.array_join("s", ",").alias("seen_by"), F.array_join(F.array_sort(F.array_except(everywhere, "s")), ",").alias("missing"))


@query("a31_fleet_roles", """WITH d AS (SELECT s_suppkey, s_suppkey % 8 AS bits, s_acctbal > 0 AS online FROM supplier), r AS (SELECT s_suppkey, online, unnest(CASE WHEN bits = 0 THEN ['unknown'] ELSE list_filter(['web', 'db', 'cache'], lambda x, i: (bits >> (i - 1)) & 1 = 1) END) AS role FROM d)
SELECT role, count(*) AS total, count(*) FILTER (online) AS online FROM r GROUP BY role""")
def a31(spark, sf):
    bit = lambda i, name: F.when(F.getbit((F.col("s_suppkey") % 8), F.lit(i)) == 1, F.lit(name))
    roles = F.array_compact(F.array(bit(0, "web"), bit(1, "db"), bit(2, "cache")))
    d = read(spark, sf, "supplier").select((F.col("s_acctbal") > 0).alias("up"), F.explode(F.when(F.size(roles) == 0, F.array(F.lit("unknown"))).otherwise(roles)).alias("role"))
    return d.groupBy("role").agg(F.count(F.lit(1)).alias("total"), F.count_if("up").alias("online"))


@query("a32_worst_finding", "SELECT c_nationkey, ['ok', 'warning', 'critical'][max(CASE WHEN c_acctbal < 0 THEN 3 WHEN c_acctbal < 1000 THEN 2 ELSE 1 END)] AS status FROM customer GROUP BY c_nationkey")
def a32(spark, sf):
    rank = F.when(F.col("c_acctbal") < 0, 3).when(F.col("c_acctbal") < 1000, 2).otherwise(1)
    names = F.array(*[F.lit(x) for x in ("ok", "warning", "critical")])
    return read(spark, sf, "customer").groupBy("c_nationkey").agg(F.max(rank).alias("r")).select("c_nationkey", F.element_at(names, F.col("r")).alias("status"))


@query("a35_path_counts", "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS dir, count(*) AS n FROM pages GROUP BY ALL")
def a35(spark, sf):
    p = read(spark, sf, "pages")
    return p.groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1).alias("dir")).agg(F.count(F.lit(1)).alias("n"))


#: Database indicators: name, aggregate, counter or gauge, window in days, operator and limit. One table drives one pass.
KPIS = [("reads", "view", "increase", 15, ">", 40000.0), ("writes", "click", "increase", 5, ">", 10000.0), ("errors", "error", "increase", 5, ">", 1000.0), ("peak", "purchase", "max", 30, ">=", 490.0), ("mean", "signup", "avg", 30, "<", 10.0)]


@query("a33_database_kpis", " UNION ALL ".join(f"SELECT '{n}' AS kpi, round({'sum(value)' if h == 'increase' else h + '(value)'}, 4) AS value, {'sum(value)' if h == 'increase' else h + '(value)'} {o} {k} AS finding FROM events WHERE event_type = '{e}' AND epoch_us(ts) > {T0} AND epoch_us(ts) <= {T0 + w * DAY}" for n, e, h, w, o, k in KPIS))
def a33(spark, sf):
    from opsframe.operators.select import compare

    e = read(spark, sf, "events").withColumn("t", micros("ts")).where(F.col("t") > T0)
    aggs = {"increase": F.sum, "max": F.max, "avg": F.avg}
    wide = e.agg(*[aggs[h](F.when((F.col("event_type") == kind) & (F.col("t") <= T0 + w * DAY), F.col("value"))).alias(n) for n, kind, h, w, _, _ in KPIS])
    rows = F.array(*[F.struct(F.lit(n).alias("kpi"), F.round(n, 4).alias("value"), compare(n, o, k).alias("finding")) for n, _, _, _, o, k in KPIS])
    return wide.select(F.inline(rows))


@query("w3_retention", f"SELECT event_id FROM events WHERE epoch_us(ts) >= {T0 + 27 * DAY} - 7 * {DAY}")
def w3(spark, sf):
    return rollup.retain(read(spark, sf, "events").withColumn("t", micros("ts")), "raw", T0 + 27 * DAY).select("event_id")


@query("w4_tier_router", f"SELECT user_id AS host, epoch_us(ts) // 300000000 * 300000000 AS ts, max(value) AS cpu_max FROM events WHERE epoch_us(ts) BETWEEN {T0} AND {T0 + 2 * DAY} GROUP BY ALL")
def w4(spark, sf):
    tier = rollup.choose_tier(2 * DAY)
    p = read(spark, sf, "events").select(F.col("user_id").alias("host"), F.col("value").alias("cpu"), micros("ts").alias("t")).where(F.col("t").between(T0, T0 + 2 * DAY))
    return rollup.to_five_minutes(p, ["host"], ["cpu"], [], size=rollup.TIERS[tier][0]).select("host", "ts", "cpu_max")
