"""Alert rules of users, as events tell them, in the form of evaluators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsframe.operators import specs
from opsframe.sources.tables import read

from .registry import query


def _map(*pairs: Column | str) -> Column:
    return F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in pairs])


@query("f31_log_rules", """SELECT user_id % 6 AS form, event_type, CASE WHEN user_id % 6 IN (1, 4) THEN 'log_volume' ELSE 'log_match' END AS kind,
 CASE user_id % 6 WHEN 0 THEN '{unit="' || event_type || '",level="warn"}' WHEN 1 THEN '{source=~".+",level="' || event_type || '"}' WHEN 2 THEN '{source=~"journald(:.*)?",unit="' || event_type || '"}'
  WHEN 3 THEN '{source=~"journald(:.*)?",service_name="' || event_type || '"}' WHEN 4 THEN '{device_id="7"}' ELSE '{source=~"journald(:.*)?"}' END AS stream_selector,
 CASE user_id % 6 WHEN 0 THEN 'user ' || (user_id // 6) || '\\.x|a|b' WHEN 1 THEN 'failed ' || (user_id // 6) WHEN 2 THEN NULL WHEN 3 THEN 'up to ' || (user_id // 6) || '|down' WHEN 4 THEN 'say "hi" ' || (user_id // 6) ELSE '(?i)oom' END AS line_filter,
 CASE WHEN user_id % 6 IN (1, 4) THEN '2' ELSE '1' END AS threshold, count(*) AS n FROM events GROUP BY ALL""")
def f31_log_rules(spark, sf):
    part, t = (F.col("user_id") % 6).alias("form"), F.col("event_type")
    # as many rules as there are different texts
    rules = read(spark, sf, "events").groupBy("event_type", part, F.expr("user_id div 6").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    form, u = F.col("form"), F.col("u").cast("string")
    spec = F.when(form == 0, _map("query", F.concat(F.lit('{unit="'), t, F.lit('", severity="warn", app="x"} |= "user '), u, F.lit('.x" |~ "a|b"')))).when(
        form == 1, _map("filter", F.concat(F.lit('|~ "level='), t, F.lit(' .*failed '), u, F.lit('"')), "ratio_op", "gte", "stream_selector", " ")).when(
        form == 2, _map("stream_selector", '{job="systemd-journal", app="y"}', "line_filter", F.concat(F.lit('|= "unit='), t, F.lit('"')))).when(
        form == 3, _map("pattern", F.concat(F.lit('(host|service_name)[=:]"'), t, F.lit('".*up to '), u, F.lit("|down")))).when(
        form == 4, _map("stream_selector", '{device_id="7", device_id="8"}', "line_filter", F.concat(F.lit('|= "say \\"hi\\" '), u, F.lit('"')))).otherwise(_map("regex", "(?i)oom"))
    out = specs.normalise(rules.withColumn("kind", F.when(form == 1, "Log-Rate").when(form == 4, "log spike").when(form.isin(0, 2), "log")).withColumn("spec", spec))
    s = F.col("spec")
    return out.groupBy("form", "event_type", "kind", s["stream_selector"].alias("stream_selector"), s["line_filter"].alias("line_filter"), F.coalesce(s["threshold"], s["ratio_threshold"]).alias("threshold")).agg(F.sum("n").alias("n"))


@query("f31_metric_rules", """SELECT user_id % 5 AS form, event_type, CASE user_id % 5 WHEN 0 THEN 'metric_threshold' WHEN 1 THEN 'metric_raw' WHEN 2 THEN 'metric_forecast' WHEN 3 THEN 'trace_error_rate' ELSE 'metric_burn_rate' END AS kind,
 CASE user_id % 5 WHEN 0 THEN 'aggregator=avg,metric=cpu_pct,operator=>,threshold=' || (user_id // 5) || ',window=5m' WHEN 1 THEN 'comparison=lt,expr=(' || event_type || '_total) < ' || (user_id // 5) || ',metric=' || event_type || '_total,metric_name=' || event_type || '_total,value=' || (user_id // 5) || '.0'
  WHEN 2 THEN 'fit_window=1h,metric=disk_used_pct,operator=>=,predict_seconds=21600,selector=mountpoint="/' || event_type || '",threshold=75' WHEN 3 THEN 'error_rate_pct=5,operator=>=,threshold_pct=5,window=5m'
  ELSE 'sli=rate(' || event_type || '[$window]),slo=95.0' END AS spec, count(*) AS n FROM events GROUP BY ALL""")
def f31_metric_rules(spark, sf):
    t, form, u = F.col("event_type"), F.col("form"), F.col("u").cast("string")
    rules = read(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 5).alias("form"), F.expr("user_id div 5").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    disk = F.concat(F.lit('node_filesystem_avail_bytes{mountpoint="/'), t, F.lit('",fstype!="tmpfs"} / node_filesystem_size_bytes{a="b",mountpoint="/'), t, F.lit('"}'))
    spec = F.when(form == 0, _map("metric", "CPU usage", "operator", "gt", "threshold", F.concat(u, F.lit(".0")))).when(
        form == 1, _map("metric_name", F.concat(t, F.lit("_total")), "comparison", "lt", "value", F.concat(u, F.lit(".0")))).when(
        form == 2, _map("expr", disk, "threshold_pct", "0.25", "operator", "=<")).when(form == 3, _map("error_rate_pct", "5")).otherwise(_map("sli", F.concat(F.lit("rate("), t, F.lit("[10m])")), "slo", "0.95"))
    out = specs.normalise(rules.withColumn("kind", F.when(form == 2, "prediction")).withColumn("spec", spec))
    shown = F.map_filter("spec", lambda k, _: (form != 2) | (k != "threshold_pct"))
    text = F.array_join(F.array_sort(F.transform(F.map_entries(shown), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",")
    return out.groupBy("form", "event_type", "kind", text.alias("spec")).agg(F.sum("n").alias("n"))
