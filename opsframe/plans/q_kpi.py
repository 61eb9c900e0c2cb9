"""The catalogue of database indicators, over samples dealt from the events to its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.operators import kpi
from opsframe.sources.tables import read

from .registry import query

AT = 1_704_067_200_000_000 + 86_400_000_000
_NAMES = kpi.metrics(kpi.CATALOGUE)
#: Labels by what tells series apart: a first-level object, one within it, and the kind of connection.
_FIRST, _SECOND, _KIND = ("schema", "datname", "schemaname", "db", "database"), ("table", "relname", "collection"), ("conn_type", "state")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """(source, name, labels, t, value): each event is a sample of one of the metrics, within a quarter of an hour, six series a metric."""
    e = read(spark, sf, "events")
    n = len(_NAMES)
    r = F.floor(F.col("event_id") / n).cast("long")
    text = lambda p, k: F.concat(F.lit(p), (r % k).cast("string"))
    labels = [x for k in _FIRST for x in (F.lit(k), text("x", 3))] + [x for k in _SECOND for x in (F.lit(k), text("y", 2))]
    labels += [x for k in _KIND for x in (F.lit(k), F.when(r % 2 == 0, "current").otherwise("available"))]
    name = F.get(F.array(*[F.lit(x) for x in _NAMES]), (F.col("event_id") % n).cast("int"))
    t = F.lit(AT) - F.col("event_id") * 89 % 900_000 * 1000
    return e.select((F.col("user_id") % 2).alias("source"), name.alias("name"), F.create_map(*labels).alias("labels"), t.alias("t"), "value")


def _sql() -> str:
    names = ", ".join(f"'{n}'" for n in _NAMES)
    parts = list(dict.fromkeys(p for k in kpi.CATALOGUE for p in k.every()))
    seconds = {"schema": 0, **{k: 0 for k in _FIRST}}

    def part(p: kpi.Part) -> str:
        here = f"name = '{p.metric}'" + "".join(f" AND series % 2 = {0 if v == 'current' else 1}" for _, v in p.where)
        if p.how == "count":
            what = "series % 3" if all(b in seconds for b in p.by) else "series"
            return f"nullif(count(DISTINCT {what}) FILTER ({here} AND last IS NOT NULL), 0)::DOUBLE"
        of = {"max": "max(last)", "min": "min(last)", "sum": "sum(last)", "rate": "sum(rate)", "increase": "sum(inc)"}[p.how]
        return f"{of} FILTER ({here})"

    place = {p: f"p{i}" for i, p in enumerate(parts)}
    there = {m: f"m{i}" for i, m in enumerate(sorted({m for k in kpi.CATALOGUE for m in k.instead_of}))}

    def value(k: kpi.Kpi) -> str:
        a, b = [place[p] for p in k.parts] + [""] * (2 - len(k.parts))
        v = {
            "plain": f"{a}", "scaled": f"{a} * {k.scale}", "percent": f"100 * {a} / greatest({b}, 1)", "rest": f"100 * (1 - {a} / greatest({b}, 1))",
            "share": f"100 * {a} / greatest({a} + {b}, 1)", "per": f"{k.scale} * {a} / greatest({b}, 1)",
        }[k.form]
        if k.strict:
            whole = f"({a} + {b})" if k.form == "share" else b
            v = f"CASE WHEN {whole} > 0 THEN 100 * {a} / {whole} END"
        elif b:
            v = f"CASE WHEN {b} IS NOT NULL THEN {v} END"
        return f"CASE WHEN {' AND '.join(there[m] + ' IS NULL' for m in k.instead_of)} THEN {v} END" if k.instead_of else v

    def limits(k: kpi.Kpi) -> str:
        some = [(k.critical_above, ">", "critical"), (k.critical_below, "<", "critical"), (k.warning_above, ">", "warning"), (k.warning_below, "<", "warning")]
        cases = "".join(f" WHEN value {o} {x!r}::DOUBLE THEN '{n}'" for x, o, n in some if x is not None)
        if not cases:
            return "NULL"
        return f"CASE{f' WHEN {place[k.least[0]]} < {k.least[1]} THEN NULL' if k.least else ''}{cases} END"

    rows = " UNION ALL ".join(
        f"SELECT source, '{k.db}' AS db, '{k.name}' AS kpi, {f'{chr(39)}{k.code}{chr(39)}' if k.code else 'NULL::VARCHAR'} AS code, value, {limits(k)} AS severity FROM (SELECT *, {value(k)} AS value FROM p)" for k in kpi.CATALOGUE)
    window = lambda w, n: f"""{n} AS (SELECT source, name, series, min(t) / 1e6 AS tf, max(t) / 1e6 AS tl, arg_min(value, t)::DOUBLE AS vf, arg_max(value, t)::DOUBLE AS vl, count(*) AS n, coalesce(sum(pv) FILTER (value < pv AND pt >= {AT - w}), 0)::DOUBLE AS resets FROM x WHERE t >= {AT - w} GROUP BY ALL),
{n}i AS (SELECT source, name, series, delta * (span + CASE WHEN delta > 0 AND vf >= 0 THEN least(l0, span * vf / delta) ELSE l0 END + r0) / span AS inc FROM (SELECT *, CASE WHEN lg < 1.1 * gap THEN lg ELSE gap / 2 END AS l0, CASE WHEN rg < 1.1 * gap THEN rg ELSE gap / 2 END AS r0
 FROM (SELECT *, vl - vf + resets AS delta, tl - tf AS span, (tl - tf) / (n - 1) AS gap, tf - {(AT - w) / 1e6!r} AS lg, {AT / 1e6!r} - tl AS rg FROM {n} WHERE n >= 2 AND tl > tf)))"""  # noqa: E731
    return f"""WITH s AS (SELECT user_id % 2 AS source, [{names}][event_id % {len(_NAMES)} + 1] AS name, event_id // {len(_NAMES)} % 6 AS series, {AT} - event_id * 89 % 900000 * 1000 AS t, value FROM events),
x AS (SELECT *, lag(value) OVER q AS pv, lag(t) OVER q AS pt FROM s WINDOW q AS (PARTITION BY source, name, series ORDER BY t)), {window(kpi.RATE, 'r')}, {window(kpi.INCREASE, 'i')},
e AS (SELECT a.source, a.name, a.series, last, ri.inc / {kpi.RATE / 1e6} AS rate, ii.inc AS inc FROM (SELECT source, name, series, arg_max(value, t) FILTER (t >= {AT - kpi.LOOKBACK}) AS last FROM s GROUP BY ALL) a LEFT JOIN ri USING (source, name, series) LEFT JOIN ii USING (source, name, series)),
p AS (SELECT source, {', '.join(f'{part(p)} AS {n}' for p, n in place.items())}, {', '.join(f"bool_or(name = '{m}') FILTER (name = '{m}') AS {n}" for m, n in there.items())} FROM e GROUP BY source)
SELECT source, db, kpi, code, round(value, 4) AS value, severity FROM ({rows}) WHERE value IS NOT NULL"""


@query("a33_kpi_catalogue", _sql())
def a33_catalogue(spark, sf):
    return kpi.evaluate(samples(spark, sf), ["source"], AT).withColumn("value", F.round("value", 4))
