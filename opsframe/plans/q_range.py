"""Range-vector functions, vector algebra and metric aggregations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsframe.functions import scalars as sc
from opsframe.operators import range as r
from opsframe.operators import vector as v
from opsframe.sources.tables import SAMPLES_SQL, read, samples

from . import registry



def query(name: str, sql: str):
    """`at` is a word of the SQL dialect, so it is quoted as a column."""
    return registry.query(name, re.sub(r"\bat\b", '"at"', sql))


S = 1_000_000
HOUR, DAY = 3600 * S, 86400 * S
T0 = 1_704_067_200 * S
GRID = r.Grid(T0 + DAY, T0 + 4 * DAY, HOUR, 6 * HOUR)
KEYS = ["name"]

#: Every sample with each evaluation time whose closed window holds it.
SPREAD = f"g AS (SELECT unnest(range({GRID.start}, {GRID.end + 1}, {GRID.step})) AS at), w AS (SELECT s.*, at FROM {{src}} s JOIN g ON s.t >= at - {GRID.window} AND s.t <= at)"
#: A counter per name that counts cents and wraps, so that it has resets.
COUNTER = (
    f"{SAMPLES_SQL}, counter AS (SELECT name, t, c % 1000000 AS value FROM (SELECT name, t, sum(round(value * 100)::BIGINT) OVER (PARTITION BY name ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS c FROM samples))"
)


def counter(spark, sf) -> DataFrame:
    c = F.sum(F.round(F.col("value") * 100).cast("long")).over(Window.partitionBy("name").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return samples(spark, sf).select("name", "t", (c % 1_000_000).cast("double").alias("value"))


def rounded(d: DataFrame, digits: int = 4) -> DataFrame:
    double = dict(d.dtypes)["value"] == "double"
    return d.withColumn("value", sc.rounded(F.col("value"), digits) if double else F.round("value", digits))


INCREASE_SQL = f"""WITH {COUNTER}, {SPREAD.format(src="counter")},
x AS (SELECT *, lag(value) OVER (PARTITION BY name, at ORDER BY t) AS pv FROM w),
a AS (SELECT name, at, min(t) / 1e6 AS tf, max(t) / 1e6 AS tl, arg_min(value, t)::DOUBLE AS vf, arg_max(value, t)::DOUBLE AS vl, count(*) AS n, coalesce(sum(pv) FILTER (value < pv), 0)::DOUBLE AS resets FROM x GROUP BY name, at HAVING count(*) >= 2),
e AS (SELECT *, vl - vf + resets AS delta, tl - tf AS span, (tl - tf) / (n - 1) AS av, tf - (at - {GRID.window}) / 1e6 AS lg, at / 1e6 - tl AS rg FROM a),
f AS (SELECT *, CASE WHEN lg < 1.1 * av THEN lg ELSE av / 2 END AS l0, CASE WHEN rg < 1.1 * av THEN rg ELSE av / 2 END AS r0 FROM e WHERE span > 0),
i AS (SELECT name, at, delta * (span + CASE WHEN delta > 0 AND vf >= 0 THEN least(l0, span * vf / delta) ELSE l0 END + r0) / span AS inc FROM f)
SELECT name, at, round(inc{{per}}, 2) AS value FROM i"""


@query("r1_rate", INCREASE_SQL.format(per=f" / {GRID.window // S}"))
def r1(spark, sf):
    return rounded(r.rate(counter(spark, sf), KEYS, GRID), 2)


@query("r2_increase", INCREASE_SQL.format(per=""))
def r2(spark, sf):
    return rounded(r.increase(counter(spark, sf), KEYS, GRID), 2)


def _over(how: str, sql: str):
    @query(f"r{ {'count': 3, 'avg': 4, 'min': 4, 'max': 4, 'stddev': 5, 'quantile': 6, 'last': 9, 'sum': 4}[how] }_{how}_over_time", f"WITH {SAMPLES_SQL}, {SPREAD.format(src='samples')} SELECT name, at, round({sql}, 6) AS value FROM w GROUP BY name, at")
    def f(spark, sf):
        return rounded(r.over_time(how, samples(spark, sf), KEYS, GRID), 6)


for _how, _sql in {"count": "count(*)::DOUBLE", "avg": "avg(value)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)", "stddev": "stddev_pop(value)", "quantile": "quantile_cont(value, 0.5)", "last": "arg_max(value, t)"}.items():
    _over(_how, _sql)


@query("r7_predict_linear", f"""WITH {SAMPLES_SQL}, {SPREAD.format(src="samples")}, f AS (SELECT name, at, regr_slope(value, (t - at) / 1e6) AS s, regr_intercept(value, (t - at) / 1e6) AS i FROM w GROUP BY name, at HAVING count(DISTINCT t) > 1)
SELECT name, at, round(i + s * 14400, 3) AS value FROM f""")
def r7(spark, sf):
    return rounded(r.predict_linear(samples(spark, sf), KEYS, GRID, 14400), 3)


@query("r8_changes", f"""WITH {SAMPLES_SQL}, s AS (SELECT name, t, floor(value / 100)::DOUBLE AS value FROM samples), {SPREAD.format(src="s")}, x AS (SELECT *, lag(value) OVER (PARTITION BY name, at ORDER BY t) AS pv FROM w)
SELECT name, at, count(*) FILTER (value <> pv)::DOUBLE AS value FROM x GROUP BY name, at""")
def r8(spark, sf):
    d = samples(spark, sf).withColumn("value", F.floor(F.col("value") / 100).cast("double"))
    return r.changes(d, KEYS, GRID)


_LES = ["10", "25", "50", "100", "250", "+Inf"]
_BUCKETS_SQL = f"""les AS (SELECT unnest([10.0, 25.0, 50.0, 100.0, 250.0, 'Infinity'::DOUBLE]) AS le),
b AS (SELECT name, le, count(*) FILTER (value <= le)::DOUBLE AS value FROM samples, les GROUP BY name, le),
c AS (SELECT *, coalesce(lag(value) OVER (PARTITION BY name ORDER BY le), 0) AS c0, lag(le) OVER (PARTITION BY name ORDER BY le) AS l0, max(value) OVER (PARTITION BY name) AS n FROM b)"""


def _hq_sql(q: float) -> str:
    return (
        f"SELECT name, {q}::DOUBLE AS q, round(CASE WHEN isinf(le) THEN l0 ELSE coalesce(l0, 0) + (le - coalesce(l0, 0)) * ({q} * n - c0) / nullif(value - c0, 0) END, 4) AS value "
        f"FROM c WHERE n > 0 AND value >= {q} * n - 1e-9 QUALIFY row_number() OVER (PARTITION BY name ORDER BY le) = 1"
    )


def buckets(d: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative buckets of values: one pass, a conditional count for each bound."""
    one = lambda le: F.count_if(F.col("value") <= float(le.replace("+Inf", "inf"))).cast("double")
    wide = d.groupBy(*keys).agg(*[one(le).alias(le) for le in _LES])
    return wide.unpivot(keys, [F.col(f"`{le}`") for le in _LES], "le", "value")


@query("r10_histogram_quantile", f"WITH {SAMPLES_SQL}, {_BUCKETS_SQL} {_hq_sql(0.5)} UNION ALL {_hq_sql(0.95)} UNION ALL {_hq_sql(0.99)}")
def r10(spark, sf):
    b = buckets(samples(spark, sf), KEYS)
    parts = [r.histogram_quantile(q, b, KEYS).select("name", F.lit(q).alias("q"), F.round("value", 4).alias("value")) for q in (0.5, 0.95, 0.99)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("r11_timestamp", f"WITH {SAMPLES_SQL} SELECT name, round(max(t) / 1e6, 3) AS value FROM samples WHERE t <= {T0 + 5 * DAY} GROUP BY name")
def r11(spark, sf):
    g = r.Grid.instant(T0 + 5 * DAY, 5 * DAY)
    return rounded(r.over_time("timestamp", samples(spark, sf), KEYS, g), 3).drop("at")


@query("r12_offset", f"WITH {SAMPLES_SQL} SELECT name, host, arg_max(value, t) AS value FROM samples WHERE t BETWEEN {T0 + 3 * DAY} AND {T0 + 4 * DAY} GROUP BY ALL")
def r12(spark, sf):
    return r.instant(samples(spark, sf), ["name", "host"], T0 + 5 * DAY, DAY, offset=DAY).df


_SUB = f"gg AS (SELECT unnest(range({T0 + DAY}, {T0 + 3 * DAY + 1}, {HOUR})) AS tt), sub AS (SELECT name, tt AS t, arg_max(value, t) AS value FROM samples JOIN gg ON t >= tt - {3 * HOUR} AND t <= tt GROUP BY name, tt)"


@query("r13_subquery", f"WITH {SAMPLES_SQL}, {_SUB} SELECT name, round(max(value), 4) AS top, round(avg(value), 4) AS mean, count(*) AS n FROM sub GROUP BY name")
def r13(spark, sf):
    sub = r.subquery(samples(spark, sf), KEYS, T0 + DAY, T0 + 3 * DAY, HOUR, 3 * HOUR)
    return sub.groupBy("name").agg(F.round(F.max("value"), 4).alias("top"), F.round(F.avg("value"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))


_LAST = f"last AS (SELECT name, host, arg_max(value, t) AS value FROM samples GROUP BY ALL)"


def last(spark, sf) -> v.Vector:
    d = samples(spark, sf).groupBy("name", "host").agg(F.max_by("value", "t").alias("value"))
    return v.Vector.of(d, ["name", "host"])


@query("r14_label_replace_join", f"WITH {SAMPLES_SQL}, {_LAST} SELECT name, host, CASE WHEN regexp_full_match(host::VARCHAR, '([0-9])([0-9]*)') THEN 'rack-' || substr(host::VARCHAR, 1, 1) ELSE '' END AS rack, name || '/' || host AS id, value FROM last")
def r14(spark, sf):
    x = v.label_replace(last(spark, sf), "rack", "rack-$1", "host", "([0-9])([0-9]*)")
    return v.label_join(x, "id", "/", "name", "host").df


@query("r15_instant_lookback", f"WITH {SAMPLES_SQL} SELECT name, host, arg_max(value, t) AS value FROM samples WHERE t BETWEEN {T0 + 5 * DAY - HOUR} AND {T0 + 5 * DAY} GROUP BY ALL")
def r15(spark, sf):
    return r.instant(samples(spark, sf), ["name", "host"], T0 + 5 * DAY, HOUR).df


@query("r16_arithmetic", f"WITH {SAMPLES_SQL}, {_LAST} SELECT name, host, round(100 * abs(value - 100) / greatest(value, 50), 4) AS value FROM last")
def r16(spark, sf):
    return rounded(last(spark, sf).map(lambda x: 100 * F.abs(x - 100) / F.greatest(x, F.lit(50.0))).df)


@query("r17_scalar_vector", f"WITH {SAMPLES_SQL} SELECT max(value) AS one, 'NaN'::DOUBLE AS many, 7.5::DOUBLE AS k FROM samples")
def r17(spark, sf):
    x = last(spark, sf)
    top = v.Vector.of(samples(spark, sf), ["name", "host"]).agg("max")
    one = top.df.agg(v.scalar(top).alias("one"))
    return one.crossJoin(x.df.agg(v.scalar(x).alias("many"))).crossJoin(v.constant(spark, 7.5).df.withColumnRenamed("value", "k"))


@query("r18_topk_bottomk", f"WITH {SAMPLES_SQL}, {_LAST} SELECT 'top' AS side, * FROM (SELECT * FROM last ORDER BY value DESC, name, host LIMIT 7) UNION ALL SELECT 'bottom', * FROM (SELECT * FROM last ORDER BY value, name, host LIMIT 7)")
def r18(spark, sf):
    x = last(spark, sf)
    return x.top(7).df.select(F.lit("top").alias("side"), "*").unionByName(x.top(7, largest=False).df.select(F.lit("bottom").alias("side"), "*"))


@query("r18_topk_by", f"WITH {SAMPLES_SQL}, {_LAST} SELECT * FROM last QUALIFY row_number() OVER (PARTITION BY name ORDER BY value DESC, host) <= 3")
def r18b(spark, sf):
    return last(spark, sf).top(3, ["name"]).df


@query("r19_idle_idiom", INCREASE_SQL.replace("SELECT name, at, round(inc{per}, 2) AS value FROM i", f"SELECT at, round(100 * (1 - avg(inc / {GRID.window // S}) / 100), 4) AS value FROM i GROUP BY at"))
def r19(spark, sf):
    d = r.rate(counter(spark, sf), KEYS, GRID)
    return rounded(d.groupBy("at").agg((100 * (1 - F.avg("value") / 100)).alias("value")))


@query("r20_delta_clamped", f"""WITH {COUNTER}, p AS (SELECT *, lag(value) OVER (PARTITION BY name ORDER BY t) AS pv, lag(t) OVER (PARTITION BY name ORDER BY t) AS pt FROM counter)
SELECT name, t, round(greatest(value - pv, 0) / ((t - pt) / 1e6), 4) AS value FROM p WHERE pt IS NOT NULL AND t > pt""")
def r20(spark, sf):
    return rounded(r.delta_clamped(counter(spark, sf), KEYS))


@query("r21_memory_fallback", "SELECT p_partkey, round(100 * (1 - coalesce(nullif(p_size, 10)::DOUBLE, p_retailprice / 100 + 1 + 2) / 100), 4) AS value FROM part")
def r21(spark, sf):
    p = read(spark, sf, "part")
    available = F.coalesce(F.nullif("p_size", F.lit(10)).cast("double"), F.col("p_retailprice") / 100 + 1 + 2)
    return p.select("p_partkey", F.round(100 * (1 - available / 100), 4).alias("value"))


# --- vector joins and spatial aggregates ----------------------------------------------------------

_AB = f"{_LAST}, a AS (SELECT host, value FROM last WHERE name = 'view'), b AS (SELECT host, value FROM last WHERE name = 'error')"


def pair(spark, sf) -> tuple[v.Vector, v.Vector]:
    x = last(spark, sf)
    one = lambda n: v.Vector.of(x.df.where(F.col("name") == n), ["host"])
    return one("view"), one("error")


@query("j1_vector_arithmetic", f"WITH {SAMPLES_SQL}, {_AB} SELECT host, round(a.value / b.value, 4) AS value FROM a JOIN b USING (host)")
def j1(spark, sf):
    a, b = pair(spark, sf)
    return rounded(a.binary(b, sc.divided, nan=True).df)


@query("j2_match_on", f"WITH {SAMPLES_SQL}, {_LAST}, m AS (SELECT name, max(value) AS value FROM last GROUP BY name), n AS (SELECT name, min(value) AS value FROM last GROUP BY name) SELECT name, round(m.value - n.value, 4) AS value FROM m JOIN n USING (name)")
def j2(spark, sf):
    x = last(spark, sf)
    return rounded(x.agg("max", ["name"]).binary(x.agg("min", ["name"]), lambda a, b: a - b, on=["name"]).df)


@query("j3_group_left_zscore", f"WITH {SAMPLES_SQL}, {_LAST}, s AS (SELECT name, avg(value) AS m, stddev_pop(value) AS d FROM last GROUP BY name) SELECT name, host, round((value - m) / nullif(d, 0), 4) AS value FROM last JOIN s USING (name) WHERE d <> 0")
def j3(spark, sf):
    x = last(spark, sf)
    centred = x.group_left(x.agg("avg", ["name"]), lambda a, b: a - b, on=["name"])
    return rounded(centred.group_left(x.agg("stddev", ["name"]), lambda a, b: a / F.nullif(b, F.lit(0.0)), on=["name"]).df)


@query("j4_and", f"WITH {SAMPLES_SQL}, {_AB} SELECT host, value FROM a WHERE host IN (SELECT host FROM b WHERE value > 50)")
def j4(spark, sf):
    a, b = pair(spark, sf)
    return a.and_(b.where(lambda x: x > 50)).df


@query("j4_and_on_nothing", f"WITH {SAMPLES_SQL}, {_AB} SELECT host, value FROM a WHERE EXISTS (SELECT 1 FROM b WHERE value > 50)")
def j4b(spark, sf):
    a, b = pair(spark, sf)
    return a.and_(b.where(lambda x: x > 50), on=[]).df


@query("j5_unless", f"WITH {SAMPLES_SQL}, {_AB} SELECT host, value FROM a WHERE host NOT IN (SELECT host FROM b WHERE value > 50)")
def j5(spark, sf):
    a, b = pair(spark, sf)
    return a.unless(b.where(lambda x: x > 50)).df


@query("j6_or", f"WITH {SAMPLES_SQL}, {_AB}, c AS (SELECT * FROM a WHERE value > 80) SELECT * FROM c UNION ALL SELECT * FROM b WHERE host NOT IN (SELECT host FROM c)")
def j6(spark, sf):
    a, b = pair(spark, sf)
    return a.where(lambda x: x > 80).or_(b).df


@query("a1_spatial_aggregates", f"WITH {SAMPLES_SQL}, {_LAST} SELECT name, round(sum(value), 4) AS s, round(avg(value), 4) AS m, min(value) AS lo, max(value) AS hi, count(*) AS n FROM last GROUP BY name")
def a1(spark, sf):
    d = last(spark, sf).df
    return d.groupBy("name").agg(F.round(F.sum("value"), 4).alias("s"), F.round(F.avg("value"), 4).alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))


@query("a2_group", f"WITH {SAMPLES_SQL}, {_LAST} SELECT host, 1.0::DOUBLE AS value FROM last GROUP BY host")
def a2(spark, sf):
    return last(spark, sf).agg("group", ["host"]).df


@query("a3_fleet_stddev", f"WITH {SAMPLES_SQL}, {_LAST} SELECT name, round(stddev_pop(value), 4) AS value FROM last GROUP BY name")
def a3(spark, sf):
    return rounded(last(spark, sf).agg("stddev", ["name"]).df)


@query("a4_nested_count", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT (l_suppkey, l_partkey)) AS pairs FROM lineitem GROUP BY l_returnflag")
def a4(spark, sf):
    d = read(spark, sf, "lineitem")
    return d.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_suppkey", "l_partkey").alias("pairs"))


@query("a5_two_level", f"WITH {SAMPLES_SQL}, {_SUB.replace('SELECT name, tt AS t', 'SELECT name, host, tt AS t').replace('GROUP BY name, tt', 'GROUP BY name, host, tt')}, d AS (SELECT host, avg(value) AS m, max(value) AS x FROM sub WHERE name = 'view' GROUP BY host) SELECT round(avg(m), 4) AS mean, max(x) AS peak FROM d")
def a5(spark, sf):
    sub = r.subquery(samples(spark, sf).where("name = 'view'"), ["host"], T0 + DAY, T0 + 3 * DAY, HOUR, 3 * HOUR)
    per = sub.groupBy("host").agg(F.avg("value").alias("m"), F.max("value").alias("x"))
    return per.agg(F.round(F.avg("m"), 4).alias("mean"), F.max("x").alias("peak"))


@query("fleet_top_k", INCREASE_SQL.replace("SELECT name, at, round(inc{per}, 2) AS value FROM i", f"SELECT name, round(avg(inc / {GRID.window // S}), 4) AS value FROM i GROUP BY name ORDER BY value DESC, name LIMIT 5"))
def fleet_top_k(spark, sf):
    d = r.rate(counter(spark, sf), KEYS, GRID).groupBy("name").agg(F.round(F.avg("value"), 4).alias("value"))
    return v.Vector.of(d, ["name"]).top(5).df


@query("s2_range_read", f"WITH {SAMPLES_SQL}, g AS (SELECT unnest(range({T0 + DAY}, {T0 + 2 * DAY + 1}, {HOUR})) AS at) SELECT name, host, at, arg_max(value, t) AS value FROM samples JOIN g ON t >= at - {2 * HOUR} AND t <= at GROUP BY ALL")
def s2(spark, sf):
    return r.over_time("last", samples(spark, sf), ["name", "host"], r.Grid(T0 + DAY, T0 + 2 * DAY, HOUR, 2 * HOUR))


@query("s1_instant_read", f"WITH {SAMPLES_SQL} SELECT name, host, arg_max(value, t) AS value FROM samples WHERE t BETWEEN {T0 + 2 * DAY - 6 * HOUR} AND {T0 + 2 * DAY} AND name = 'view' GROUP BY ALL")
def s1(spark, sf):
    return r.instant(samples(spark, sf).where("name = 'view'"), ["name", "host"], T0 + 2 * DAY, 6 * HOUR).df


@query("a36_freshness", f"WITH {SAMPLES_SQL} SELECT name, max(t) AS t FROM samples GROUP BY name")
def a36(spark, sf):
    return samples(spark, sf).groupBy("name").agg(F.max("t").alias("t"))
