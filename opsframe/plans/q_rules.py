"""Alert rules, incidents, notifications."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opsframe.operators import rules as ru
from opsframe.operators.red import held_for
from opsframe.sources.tables import SAMPLES_SQL, micros, read, samples

from .q_range import T0, last, pair, rounded
from .registry import query

S = 1_000_000
HOUR, DAY = 3600 * S, 86400 * S
_LAST = "last AS (SELECT name, host, arg_max(value, t) AS value FROM samples GROUP BY ALL), a AS (SELECT host, value FROM last WHERE name = 'view'), b AS (SELECT host, value FROM last WHERE name = 'error')"
#: Hourly sums per kind: what the hourly rules look at.
_HOURLY = f"h AS (SELECT event_type AS name, epoch_us(ts) // {HOUR} * {HOUR} AS t, sum(value) AS value FROM events GROUP BY ALL)"


def hourly(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("name"), (F.floor(micros("ts") / F.lit(HOUR)) * HOUR).cast("long").alias("t"), "value")
    return e.groupBy("name", "t").agg(F.sum("value").alias("value"))


def fired(spark, sf):
    return hourly(spark, sf).where("value > 250")


@query("ar1_metric_raw", f"WITH {SAMPLES_SQL}, {_LAST} SELECT name, host, value FROM last WHERE value > 150")
def ar1(spark, sf):
    return last(spark, sf).where(lambda x: x > 150).df


@query("ar2_threshold_all", f"WITH {SAMPLES_SQL}, {_LAST} SELECT host, value FROM a WHERE value > 20 AND host IN (SELECT host FROM b WHERE value < 100)")
def ar2(spark, sf):
    a, b = pair(spark, sf)
    return ru.threshold([(a, ">", 20), (b, "<", 100)], True, ["host"]).df


@query("ar2_threshold_any", f"WITH {SAMPLES_SQL}, {_LAST}, c AS (SELECT * FROM a WHERE value > 90) SELECT * FROM c UNION ALL SELECT * FROM b WHERE value < 10 AND host NOT IN (SELECT host FROM c)")
def ar2b(spark, sf):
    a, b = pair(spark, sf)
    return ru.threshold([(a, ">", 90), (b, "<", 10)], False, ["host"]).df


_AT, _WIN, _STEP = T0 + 20 * DAY, 10 * DAY, DAY
_GRID = f"g AS (SELECT unnest(range({_AT - _WIN + _STEP}, {_AT + 1}, {_STEP})) AS tt), p AS (SELECT name, host, tt, arg_max(value, t) AS value FROM samples JOIN g ON t >= tt - {_STEP} AND t <= tt GROUP BY name, host, tt)"


@query("ar3_anomaly_zscore", f"""WITH {SAMPLES_SQL}, {_GRID}, s AS (SELECT name, host, arg_max(value, tt) AS now, avg(value) AS c, stddev_pop(value) AS d FROM p GROUP BY name, host)
SELECT name, host, now AS value, round(abs(now - c) / d, 4) AS score FROM s WHERE d > 0 AND abs(now - c) / d >= 1.2""")
def ar3(spark, sf):
    out = ru.anomaly(samples(spark, sf), ["name", "host"], _AT, _WIN, _STEP, 1.2)
    return out.withColumn("score", F.round("score", 4))


@query("ar3_anomaly_mad", f"""WITH {SAMPLES_SQL}, {_GRID}, m AS (SELECT name, host, arg_max(value, tt) AS now, quantile_cont(value, 0.5) AS c FROM p GROUP BY name, host), s AS (SELECT name, host, any_value(now) AS now, any_value(c) AS c, avg(abs(value - c)) AS d FROM p JOIN m USING (name, host) GROUP BY name, host)
SELECT name, host, now AS value, round(abs(now - c) / d, 4) AS score FROM s WHERE d > 0 AND abs(now - c) / d >= 1.8""")
def ar3b(spark, sf):
    out = ru.anomaly(samples(spark, sf), ["name", "host"], _AT, _WIN, _STEP, 1.8, "mad")
    return out.withColumn("score", F.round("score", 4))


@query("ar4_forecast", f"""WITH {SAMPLES_SQL}, f AS (SELECT name, host, regr_slope(value, (t - {_AT}) / 1e6) AS s, regr_intercept(value, (t - {_AT}) / 1e6) AS i FROM samples WHERE t BETWEEN {_AT - 5 * DAY} AND {_AT} GROUP BY ALL HAVING count(DISTINCT t) > 1)
SELECT name, host, round(i + s * 86400, 3) AS value FROM f WHERE i + s * 86400 > 100""")
def ar4(spark, sf):
    return rounded(ru.forecast(samples(spark, sf), ["name", "host"], _AT, 5 * DAY, 86400, ">", 100), 3)


@query("ar5_burn_rate", f"""WITH w AS (SELECT user_id AS host, count(*) FILTER (t > {_AT - 2 * DAY}) AS n0, count(*) FILTER (t > {_AT - 2 * DAY} AND bad) AS e0, count(*) AS n1, count(*) FILTER (bad) AS e1
FROM (SELECT user_id, epoch_us(ts) AS t, event_type = 'error' AS bad FROM events) WHERE t > {_AT - 10 * DAY} AND t <= {_AT} GROUP BY 1)
SELECT host, round(greatest(coalesce(e0 / nullif(n0, 0), 0), coalesce(e1 / nullif(n1, 0), 0)), 6) AS value FROM w WHERE e0 / nullif(n0, 0) >= 2 * 0.1 AND e1 / nullif(n1, 0) >= 1.5 * 0.1""")
def ar5(spark, sf):
    q = read(spark, sf, "events").select(F.col("user_id").alias("host"), micros("ts").alias("t"), (F.col("event_type") == "error").alias("error"))
    out = ru.burn_rate(q, ["host"], _AT, [(2 * DAY, 2.0), (10 * DAY, 1.5)], 90.0)
    return out.withColumn("value", F.round("value", 6))


@query("ar6_log_search_grouped", f"SELECT user_id AS host, count(*) AS n FROM events WHERE event_type = 'error' AND epoch_us(ts) > {_AT - 5 * DAY} AND epoch_us(ts) <= {_AT} GROUP BY 1 HAVING count(*) >= 3")
def ar6(spark, sf):
    from opsframe.operators.logs import count_by
    from opsframe.operators.select import LogRequest
    from opsframe.sources.tables import logs

    n = count_by(logs(spark, sf), LogRequest(_AT - 5 * DAY, _AT, scope={"service": ["error"]}), ["host"], limit=None)
    return n.where("n >= 3").select(F.col("host").cast("long").alias("host"), "n")


@query("ar7_log_match", f"SELECT count(*) AS n FROM events WHERE contains(event_type || ' ' || props, '9') AND epoch_us(ts) > {_AT - DAY} AND epoch_us(ts) <= {_AT} HAVING count(*) > 5")
def ar7(spark, sf):
    from opsframe.operators.select import log_query
    from opsframe.sources.tables import logs

    d = logs(spark, sf).where(log_query('{} |= "9"') & (F.col("t") > _AT - DAY) & (F.col("t") <= _AT))
    return d.agg(F.count(F.lit(1)).alias("n")).where("n > 5")


@query("ar8_trace_latency", f"SELECT event_type AS service, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1 HAVING quantile_cont(value, 0.95) > 100")
def ar8(spark, sf):
    return read(spark, sf, "events").groupBy(F.col("event_type").alias("service")).agg(F.percentile("value", 0.95).alias("p95")).where("p95 > 100").withColumn("p95", F.round("p95", 4))


@query("ar9_trace_error_rate", "SELECT user_id AS service, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 6) AS rate FROM events GROUP BY 1 HAVING 100.0 * count(*) FILTER (event_type = 'error') / count(*) > 25")
def ar9(spark, sf):
    g = read(spark, sf, "events").groupBy(F.col("user_id").alias("service")).agg((100.0 * F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("rate"))
    return g.where("rate > 25").withColumn("rate", F.round("rate", 6))


@query("ar10_dwell", f"WITH {_HOURLY} SELECT name FROM h WHERE t > {_AT - 6 * HOUR} AND t <= {_AT} GROUP BY name HAVING count(*) FILTER (value > 20) = 6")
def ar10(spark, sf):
    h = hourly(spark, sf).where((F.col("t") > _AT - 6 * HOUR) & (F.col("t") <= _AT))
    return held_for(h, ["name"], F.col("value") > 20, 6)


#: Built-in rules: name, kind, operator, threshold.
SEED = [("cpu_high", "view", ">", 400.0), ("memory_high", "click", ">", 300.0), ("disk_full", "purchase", ">=", 450.0), ("idle", "signup", "<", 1.0), ("errors", "error", ">", 480.0)]


@query("ar11_seed_rules", " UNION ALL ".join(f"SELECT '{n}' AS rule, event_id, value FROM events WHERE event_type = '{k}' AND value {o} {x}" for n, k, o, x in SEED))
def ar11(spark, sf):
    from opsframe.operators.select import compare

    # all rules in one pass over the samples
    hits = F.array_compact(F.array(*[F.when((F.col("event_type") == k) & compare("value", o, x), F.lit(n)) for n, k, o, x in SEED]))
    return read(spark, sf, "events").select(F.explode(hits).alias("rule"), "event_id", "value")


@query("ar12_for_duration", f"""WITH {_HOURLY}, c AS (SELECT *, value > 100 AS ok FROM h), i AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY t) - row_number() OVER (PARTITION BY name, ok ORDER BY t) AS k FROM c)
SELECT name, min(t) AS since, max(t) AS until FROM i WHERE ok GROUP BY name, k HAVING max(t) - min(t) >= {2 * HOUR}""")
def ar12(spark, sf):
    return ru.contiguous(hourly(spark, sf), ["name"], F.col("value") > 100, 2 * HOUR)


@query("ar13_rule_preview", f"""WITH {_HOURLY}, f AS (SELECT * FROM h WHERE value > 250)
SELECT count(*) AS fires, min(t) AS first, max(t) AS last, (SELECT array_to_string(list(round(value, 2) ORDER BY t DESC, value DESC), ',') FROM (SELECT * FROM f ORDER BY t DESC, value DESC LIMIT 5)) AS samples FROM f""")
def ar13(spark, sf):
    out = ru.preview(fired(spark, sf))
    return out.withColumn("samples", F.array_join(F.transform("samples", lambda x: F.round(x, 2).cast("string")), ","))


@query("ar14_representative_series", "SELECT user_id AS host, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1 ORDER BY n DESC, avg(value) DESC, host LIMIT 1")
def ar14(spark, sf):
    p = read(spark, sf, "events").select(F.col("user_id").alias("host"), "value")
    return ru.representative(p, ["host"]).withColumn("mean", F.round("mean", 4))


@query("ar14_thinned_series", f"""WITH {_HOURLY}, n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY name) AS c FROM h) SELECT name, t FROM n WHERE k % greatest(1, ceil(c / 60))::BIGINT = 0 OR k = c - 1""")
def ar14b(spark, sf):
    return ru.thin(hourly(spark, sf), ["name"], 60).select("name", "t")


@query("ar15_incidents", f"""WITH {_HOURLY}, f AS (SELECT name, t FROM h WHERE value > 250), x AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY name ORDER BY t) <= {HOUR} THEN 0 ELSE 1 END AS new FROM f),
y AS (SELECT *, sum(new) OVER (PARTITION BY name ORDER BY t) AS incident FROM x), e AS (SELECT max(t) AS m FROM f)
SELECT name, incident::BIGINT AS incident, min(t) AS opened, max(t) AS last_fired, count(*) AS fires, CASE WHEN max(t) < any_value(m) THEN max(t) + {HOUR} END AS resolved FROM y, e GROUP BY name, incident""")
def ar15(spark, sf):
    return ru.incidents(fired(spark, sf), ["name"], HOUR)


@query("ar16_dedupe_key", "SELECT DISTINCT '4:host=' || length(user_id::VARCHAR) || ':' || user_id || ',4:kind=' || length(event_type) || ':' || event_type AS key FROM events")
def ar16(spark, sf):
    labels = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("host"), F.col("user_id").cast("string"), F.lit("job"), F.lit("x"))
    return read(spark, sf, "events").select(ru.dedupe_key(labels).alias("key")).distinct()


@query("ar17_recovery_sweep", f"WITH {_HOURLY} SELECT DISTINCT name FROM h WHERE value > 50 AND t = {_AT - HOUR} AND name NOT IN (SELECT name FROM h WHERE value > 50 AND t = {_AT})")
def ar17(spark, sf):
    at = lambda t: hourly(spark, sf).where((F.col("value") > 50) & (F.col("t") == t)).select("name")
    return ru.recovered(at(_AT - HOUR), at(_AT), ["name"]).distinct()


@query("ar18_notification_chain", f"""WITH RECURSIVE {_HOURLY}, f AS (SELECT name, t, value, row_number() OVER (PARTITION BY name ORDER BY t) AS k, count(*) OVER (PARTITION BY name ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS recent FROM h WHERE value > 150),
n(name, k, t, outcome, last) AS (
 SELECT name, 0::BIGINT, 0::BIGINT, '', NULL::BIGINT FROM (SELECT DISTINCT name FROM f)
 UNION ALL SELECT f.name, f.k, f.t, o.outcome, CASE WHEN o.outcome = 'notified' THEN f.t ELSE n.last END FROM n JOIN f ON f.name = n.name AND f.k = n.k + 1,
 LATERAL (SELECT CASE WHEN f.t % {DAY} < {3 * HOUR} THEN 'silenced' WHEN f.t - n.last < {12 * HOUR} THEN 'cooldown' WHEN f.recent < 2 THEN 'dampened' WHEN f.name = 'view' THEN 'inhibited' ELSE 'notified' END AS outcome) o)
SELECT name, t, outcome FROM n WHERE k > 0""")
def ar18(spark, sf):
    f = hourly(spark, sf).where("value > 150")
    return ru.notifications(f, ["name"], F.col("t") % DAY < 3 * HOUR, 12 * HOUR, DAY, 2, F.col("name") == "view")


@query("ar19_delivery_retry", f"SELECT event_id FROM events WHERE event_id % 7 < 5 AND epoch_us(ts) + (event_id % 7) * 60000000 <= {_AT}")
def ar19(spark, sf):
    d = read(spark, sf, "events").select("event_id", (F.col("event_id") % 7).alias("attempts"), micros("ts").alias("finished"))
    return ru.retry_due(d, _AT).select("event_id")


@query("w13_staleness", f"WITH {SAMPLES_SQL} SELECT host, {_AT} - max(t) AS age FROM samples WHERE t <= {_AT} GROUP BY host")
def w13(spark, sf):
    return samples(spark, sf).where(F.col("t") <= _AT).groupBy("host").agg((F.lit(_AT) - F.max("t")).alias("age"))


@query("w12_counter_state", f"WITH {SAMPLES_SQL}, p AS (SELECT name, host, t, value - lag(value) OVER (PARTITION BY name, host ORDER BY t) AS d FROM samples) SELECT name, host, round(sum(greatest(d, 0)), 4) AS grown FROM p WHERE d IS NOT NULL GROUP BY ALL")
def w12(spark, sf):
    w = Window.partitionBy("name", "host").orderBy("t")
    p = samples(spark, sf).withColumn("d", F.col("value") - F.lag("value").over(w)).where("d is not null")
    return p.groupBy("name", "host").agg(F.round(F.sum(F.greatest(F.col("d"), F.lit(0.0))), 4).alias("grown"))


