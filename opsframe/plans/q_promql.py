"""Queries in the metric query language."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.functions.scalars import rounded
from opsframe.operators import promql
from opsframe.sources.tables import SAMPLES_SQL, samples

from .q_range import INCREASE_SQL, S, T0, counter, query

DAY, H = 86400 * S, 3600 * S
AT = T0 + 4 * DAY
_LAST = f"last AS (SELECT name, host, arg_max(value, t) AS value FROM samples WHERE t BETWEEN {AT - 2 * DAY} AND {AT} GROUP BY ALL)"


def run(spark, sf, text, digits=4, lookback=2 * DAY):
    d = promql.evaluate(text, samples(spark, sf).withColumn("host", F.col("host").cast("string")), ["host"], AT, lookback).df
    return d.withColumn("value", rounded(F.col("value"), digits))


@query("promql_selector_arithmetic", f"WITH {SAMPLES_SQL}, {_LAST} SELECT host::VARCHAR AS host, round(100 * (value - 3) / 2, 4) AS value FROM last WHERE name = 'view' AND regexp_full_match(host::VARCHAR, '1.*')")
def p1(spark, sf):
    return run(spark, sf, '100 * (view{host=~"1.*"} - 3) / 2')


@query("promql_aggregate_over_time", f"WITH {SAMPLES_SQL} SELECT round(max(m), 4) AS value FROM (SELECT host, avg(value) AS m FROM samples WHERE name = 'view' AND t BETWEEN {AT - 2 * DAY} AND {AT} GROUP BY host)")
def p2(spark, sf):
    return run(spark, sf, "max(avg_over_time(view[2d]))")


@query("promql_ratio_on", f"WITH {SAMPLES_SQL}, {_LAST}, e AS (SELECT host, value FROM last WHERE name = 'error'), v AS (SELECT host, value FROM last WHERE name = 'view') SELECT e.host::VARCHAR AS host, round(e.value / v.value, 4) AS value FROM e JOIN v USING (host) WHERE round(e.value / v.value, 9) > 0.5")
def p3(spark, sf):
    return run(spark, sf, "error / on(host) view > 0.5")


@query("promql_or_default_zero", f"WITH {SAMPLES_SQL}, {_LAST}, e AS (SELECT host, value FROM last WHERE name = 'error'), v AS (SELECT host, value FROM last WHERE name = 'view') SELECT host::VARCHAR AS host, value FROM e UNION ALL SELECT host::VARCHAR, 0.0 FROM v WHERE host NOT IN (SELECT host FROM e)")
def p4(spark, sf):
    return run(spark, sf, "error or 0 * view")


@query("promql_unless_and", f"WITH {SAMPLES_SQL}, {_LAST} SELECT host::VARCHAR AS host, value FROM last WHERE name = 'view' AND host NOT IN (SELECT host FROM last WHERE name = 'error' AND value > 40) AND host IN (SELECT host FROM last WHERE name = 'click')")
def p5(spark, sf):
    return run(spark, sf, "view unless error > 40 and click")


@query("promql_zscore", f"WITH {SAMPLES_SQL}, {_LAST}, v AS (SELECT host, value FROM last WHERE name = 'view'), s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM v) SELECT host::VARCHAR AS host, round((value - m) / d, 4) AS value FROM v, s")
def p6(spark, sf):
    return run(spark, sf, "(view - on() group_left avg(view)) / on() group_left stddev(view)")


@query("promql_topk", f"WITH {SAMPLES_SQL}, {_LAST} SELECT host::VARCHAR AS host, value FROM last WHERE name = 'view' ORDER BY value DESC, host::VARCHAR LIMIT 5")
def p7(spark, sf):
    return run(spark, sf, "topk(5, view)")


@query("promql_subquery", f"WITH {SAMPLES_SQL}, g AS (SELECT unnest(range({AT - DAY}, {AT + 1}, {H})) AS tt), p AS (SELECT host, tt, arg_max(value, t) AS value FROM samples JOIN g ON t >= tt - {2 * DAY} AND t <= tt WHERE name = 'view' GROUP BY host, tt) SELECT host::VARCHAR AS host, round(max(value), 4) AS value FROM p GROUP BY host")
def p8(spark, sf):
    return run(spark, sf, "max_over_time(view[1d:1h])")


@query("promql_rate_range", INCREASE_SQL.format(per=f" / {6 * 3600}").replace("SELECT name, at, round", "SELECT at, round").replace("FROM i", "FROM i WHERE name = 'view'"))
def p9(spark, sf):
    d = counter(spark, sf)
    out = promql.evaluate_range("rate(view[6h])", d, [], T0 + DAY, T0 + 4 * DAY, H)
    return out.withColumn("value", F.round("value", 2))
