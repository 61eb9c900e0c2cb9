"""Request rate, errors and durations of services, from counters of requests in latency buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .range import Grid, increase

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def summarise(samples: DataFrame, keys: Sequence[str], at: int, window: int) -> DataFrame:
    """(keys, rps, error_rate, p50, p95, p99 in ms) from cumulative counters (keys, status, le, t, value).

    One rate per series, before any sum; rows of le = 'count' are the request counters. rps is null
    without samples, and without requests every ratio and quantile is null.
    """
    rates = increase(samples, [*keys, "status", "le"], Grid.instant(at, window), per_second=True)
    by_le = rates.groupBy(*keys, "le").agg(F.sum("value").alias("value"), F.sum(F.when(F.col("status") >= "500", F.col("value")).otherwise(0.0)).alias("bad"))
    count = F.col("le") == "count"
    series = by_le.groupBy(*keys).agg(F.max(F.when(count, F.col("value"))).alias("rps"), F.max(F.when(count, F.col("bad"))).alias("bad"), _buckets(~count))
    error_rate = (F.col("bad") / F.nullif(F.col("rps"), F.lit(0.0))).alias("error_rate")
    return series.where("rps is not null").select(*keys, "rps", error_rate, _quantiles(1000).alias("q")).select(*keys, "rps", "error_rate", *_named())


def quantiles(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """QUANTILES of each series' cumulative buckets (keys, le, value), from one array of sorted buckets a series: one shuffle, no window."""
    return buckets.groupBy(*keys).agg(_buckets(F.lit(True))).select(*keys, _quantiles(1).alias("q")).select(*keys, *_named())


def _buckets(which: Column) -> Column:
    le = F.when(F.col("le").isin("+Inf", "Infinity"), float("inf")).otherwise(F.col("le").try_cast("double"))
    return F.array_sort(F.collect_list(F.when(which, F.struct(le.alias("le"), F.col("value").alias("c"))))).alias("b")


def _named() -> list[Column]:
    return [F.get("q", F.lit(i)).alias(name) for i, name in enumerate(QUANTILES)]


def _quantiles(unit: int) -> Column:
    """The array of QUANTILES of the sorted buckets b, times unit; one expression for all of them, in which a rank's bucket is looked for once."""
    n = F.element_at("b", -1)

    def inside(rank: Column, k: Column) -> Column:
        hit = F.get("b", k)
        l0, c0 = (F.when(k > 0, F.get("b", k - 1)[x]).otherwise(0.0) for x in ("le", "c"))
        at = l0 + (hit["le"] - l0) * F.when(hit["c"] > c0, (rank - c0) / (hit["c"] - c0)).otherwise(0.0)
        return F.when(hit["le"] == float("inf"), F.when(k > 0, l0)).otherwise(at) * unit

    ranks = F.transform(F.array(*[F.lit(q) for q in QUANTILES.values()]), lambda q: q * n["c"])
    found = F.transform(ranks, lambda r: F.struct(r.alias("r"), F.size(F.filter("b", lambda x: x["c"] < r - 1e-9)).alias("k")))
    return F.when((F.size("b") > 0) & (n["le"] == float("inf")) & (n["c"] > 0), F.transform(found, lambda x: inside(x["r"], x["k"])))


def combine(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Protocols of a service to one row: rates add up, errors are weighted by requests, quantiles of several parts aren't combined. A null part makes the sum null."""
    whole = F.count("rps") == F.count(F.lit(1))
    one = F.count(F.lit(1)) == 1
    weighted = F.sum(F.col("rps") * F.col("error_rate")) / F.nullif(F.sum("rps"), F.lit(0.0))
    return parts.groupBy(*keys).agg(F.when(whole, F.sum("rps")).alias("rps"), F.when(whole, weighted).alias("error_rate"), *[F.when(one, F.first(q)).alias(q) for q in QUANTILES])


def dependencies(calls: DataFrame, client: str, server: str, other: Sequence[str], limit: int = 200) -> DataFrame:
    """Edges between services with calls and errors; no edge to itself or from the virtual user; the largest ones."""
    edges = calls.where((F.col(client) != F.col(server)) & (F.col(client) != "user")).groupBy(client, server, *other)
    out = edges.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("error").cast("double")).alias("error_rate"), F.percentile("duration", 0.95).alias("p95"))
    return out.orderBy(F.desc("n"), client, server, *other).limit(limit)


def status(rps: str = "rps"):
    """no samples, no requests or ok: missing isn't zero."""
    return F.when(F.col(rps).isNull(), "insufficient_samples").when(F.col(rps) == 0, "no_requests").otherwise("ok")


def held_for(values: DataFrame, keys: Sequence[str], condition, points: int) -> DataFrame:
    """Series whose condition is true at each of `points` evaluation times."""
    return values.groupBy(*keys).agg(F.count_if(condition).alias("k")).where(F.col("k") == points).select(*keys)


def request_table(spark, services: int = 1000, points: int = 11) -> DataFrame:
    """The benchmark table: 28 counters a service, a point a minute, a quarter of the requests failing."""
    shares = {"0.01": 0.75, "0.05": 0.9, "0.1": 0.95, "0.5": 0.99, "1": 1.0, "+Inf": 1.0, "count": 1.0}
    rows = [(p, s, le, w * f) for p in ("http", "rpc") for s, w in (("200", 3), ("500", 1)) for le, f in shares.items()]
    series = spark.createDataFrame(rows, "protocol string, status string, le string, share double")
    grid = spark.range(services).select(F.concat(F.lit("service-"), F.col("id").cast("string")).alias("service")).crossJoin(F.broadcast(series))
    at = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("p")
    return grid.select("service", "protocol", "status", "le", "share", at).select("service", "protocol", "status", "le", (F.col("p").cast("long") * 60_000_000).alias("t"), ((F.col("p") + 1) * 100 * F.col("share")).alias("value"))

