"""Services and dependencies with mergeable latency distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.operators import latency
from opsframe.operators.red import QUANTILES
from opsframe.sources.tables import micros, read

from .registry import query

_G = latency.base(latency.ERROR)
_BUCKET = f"CASE WHEN v > 0 THEN ceil(ln(v) / ln({_G!r}::DOUBLE))::INT ELSE {latency.ZERO} END"


def _quantiles_sql(keys: str, values: str, more: str = "") -> str:
    """Quantiles of (keys, v) by rank among the buckets."""
    pick = ", ".join(f"round(CASE WHEN min(b) FILTER (c >= greatest(ceil({q} * whole - 1e-9), 1)) = {latency.ZERO} THEN 0 ELSE 2 * pow({_G!r}::DOUBLE, min(b) FILTER (c >= greatest(ceil({q} * whole - 1e-9), 1))) / {_G + 1!r} END, 6) AS {n}" for n, q in QUANTILES.items())
    return f"""WITH v AS ({values}), h AS (SELECT {keys}, {_BUCKET} AS b, count(*) AS n{', sum(bad) AS bad' if more else ''} FROM v GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY b) AS c, sum(n) OVER (PARTITION BY {keys}) AS whole FROM h) SELECT {keys}, sum(n)::BIGINT AS n{more}, {pick} FROM k GROUP BY {keys}"""


@query("a7_latency_quantiles", _quantiles_sql("service, protocol", "SELECT event_type AS service, user_id % 3 AS protocol, value AS v FROM events"))
def a7_quantiles(spark, sf):
    calls = read(spark, sf, "events").select(F.col("event_type").alias("service"), (F.col("user_id") % 3).alias("protocol"), F.col("value").alias("v"))
    out = latency.quantiles(latency.distribution(calls, ["service", "protocol"], "v"), ["service", "protocol"], QUANTILES)
    return out.select("service", "protocol", "n", *[F.round(q, 6).alias(q) for q in QUANTILES])


@query("a7_latency_rolled_up", _quantiles_sql("service, day", "SELECT event_type AS service, epoch_us(ts) // 86400000000 AS day, value AS v FROM events"))
def a7_rolled_up(spark, sf):
    """Five minutes by protocol, then hours, then days: what is merged last has what came first."""
    at = lambda us: F.expr(f"t div {us}")
    calls = read(spark, sf, "events").select(F.col("event_type").alias("service"), (F.col("user_id") % 3).alias("protocol"), F.col("value").alias("v"), micros("ts").alias("t"))
    fine = latency.distribution(calls.withColumn("t", at(300_000_000)), ["service", "protocol", "t"], "v")
    hours = latency.merge(fine.withColumn("t", at(12)), ["service", "t"])
    days = latency.merge(hours.withColumn("day", at(24)), ["service", "day"])
    return latency.quantiles(days, ["service", "day"], QUANTILES).select("service", "day", "n", *[F.round(q, 6).alias(q) for q in QUANTILES])


_CALLS = """SELECT sn.n_name AS client, cn.n_name AS server, l_returnflag AS kind, (l_discount > 0.05)::INT AS bad, l_extendedprice AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
JOIN customer ON o_custkey = c_custkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN nation cn ON c_nationkey = cn.n_nationkey WHERE sn.n_nationkey <> cn.n_nationkey"""


@query("a10_dependency_latency", f"SELECT * FROM ({_quantiles_sql('client, server, kind', _CALLS, ', round(sum(bad) / sum(n), 6) AS error_rate')}) ORDER BY n DESC, client, server, kind LIMIT 200")
def a10_latency(spark, sf):
    """Calls are counted by keys of places and bucket; names come to the edges that are left."""
    l, o, s, c = (read(spark, sf, t) for t in ("lineitem", "orders", "supplier", "customer"))
    calls = l.join(o.select("o_orderkey", "o_custkey"), l.l_orderkey == o.o_orderkey).join(s.select("s_suppkey", "s_nationkey"), l.l_suppkey == s.s_suppkey).join(c.select("c_custkey", "c_nationkey"), o.o_custkey == c.c_custkey)
    keys = ["s_nationkey", "c_nationkey", "kind"]
    calls = calls.where("s_nationkey <> c_nationkey").select("s_nationkey", "c_nationkey", F.col("l_returnflag").alias("kind"), (F.col("l_discount") > 0.05).cast("int").alias("bad"), "l_extendedprice")
    edges = latency.quantiles(latency.distribution(calls, keys, "l_extendedprice", sums={"bad": F.col("bad")}), keys, QUANTILES, sums=["bad"])
    n = read(spark, sf, "nation")
    name = lambda key, col: n.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(col))
    named = edges.join(F.broadcast(name("s_nationkey", "client")), "s_nationkey").join(F.broadcast(name("c_nationkey", "server")), "c_nationkey")
    top = named.orderBy(F.desc("n"), "client", "server", "kind").limit(200)
    return top.select("client", "server", "kind", "n", F.round(F.col("bad") / F.col("n"), 6).alias("error_rate"), *[F.round(q, 6).alias(q) for q in QUANTILES])
