"""Filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.operators import select as s
from opsframe.sources.tables import LOGS_SQL, SAMPLES_SQL, logs, read, samples

from .registry import query

DAY = 86_400_000_000
T0 = 1_704_067_200_000_000
COLS = "name, host, value, t"


@query("f1_label_matchers", f"""WITH {SAMPLES_SQL} SELECT {COLS} FROM samples
WHERE regexp_full_match(name, 'view|cl.*') AND name <> 'click' AND NOT regexp_full_match(host::VARCHAR, '1.') AND host::VARCHAR <> '7'""")
def f1(spark, sf):
    return samples(spark, sf).where(s.match([("name", "=~", "view|cl.*"), ("name", "!=", "click"), ("host", "!~", "1."), ("host", "!=", "7")]))


@query("f2_selector_merge", f"WITH {SAMPLES_SQL} SELECT {COLS} FROM samples WHERE name = 'view' AND host IN (3, 4)")
def f2(spark, sf):
    name, own = s.parse_selector('view{host="1",absent=""}')
    merged = s.merge_matchers([m for m in own if m[0] != "absent"], [("host", "=~", "3|4")])
    return samples(spark, sf).where(s.match([("name", "=", name), *merged]))


@query("f3_selector_splice", f"WITH {SAMPLES_SQL} SELECT {COLS} FROM samples WHERE name = 'error' AND host = 5")
def f3(spark, sf):
    name, matchers = s.parse_selector(s.splice('error{host="1"}', [("host", "=", "5")], "err"))
    return samples(spark, sf).where(s.match([("name", "=", name), *matchers]))


@query("f4_device_filter", f"WITH {SAMPLES_SQL} SELECT {COLS} FROM samples WHERE host IN (1, 2, 3)")
def f4(spark, sf):
    return samples(spark, sf).where(s.in_set("host", [1, 2, 3]))


@query("f5_empty_device_set", f"WITH {SAMPLES_SQL} SELECT {COLS} FROM samples WHERE false")
def f5(spark, sf):
    return samples(spark, sf).where(s.in_set("host", []))


@query("f6_identity_pair", f"WITH {SAMPLES_SQL} SELECT {COLS} FROM samples WHERE (name = 'view' AND host = 1) OR (name = 'error' AND host = 2)")
def f6(spark, sf):
    return samples(spark, sf).where(s.identity([{"name": "view", "host": 1}, {"name": "error", "host": 2}]))


@query("f7_value_comparison", f"WITH {SAMPLES_SQL} SELECT {COLS} FROM samples WHERE value > 20 AND value <= 90.5 AND value <> 50")
def f7(spark, sf):
    return samples(spark, sf).where(s.compare("value", ">", 20) & s.compare("value", "<=", 90.5) & s.compare("value", "!=", 50))


@query("f8_time_range_forms", f"""WITH {SAMPLES_SQL}, b AS (SELECT min(t) AS lo, max(t) AS hi FROM samples)
SELECT count(*) FILTER (t > lo AND t <= hi) AS half_open, count(*) FILTER (t >= lo AND t <= hi) AS closed FROM samples, b""")
def f8(spark, sf):
    d = samples(spark, sf)
    b = d.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return d.crossJoin(F.broadcast(b)).agg(F.count_if((F.col("t") > F.col("lo")) & (F.col("t") <= F.col("hi"))).alias("half_open"), F.count_if(F.col("t").between(F.col("lo"), F.col("hi"))).alias("closed"))


LOGCOLS = "id, t, service, host, severity_text, message"


@query("f9_log_scope", f"WITH {LOGS_SQL} SELECT {LOGCOLS} FROM logs WHERE t BETWEEN {T0} AND {T0 + 10 * DAY} AND service IN ('error', 'signup') AND host IN (1, 2, 3, 4, 5) AND severity_text IN ('error')")
def f9(spark, sf):
    r = s.LogRequest(T0, T0 + 10 * DAY, scope={"service": ["error", "signup"], "host": [1, 2, 3, 4, 5], "severity_text": ["error"], "cluster": []})
    return logs(spark, sf).where(r.validate().condition())


@query("f10_log_field_filters", f"""WITH {LOGS_SQL} SELECT {LOGCOLS} FROM logs WHERE t BETWEEN {T0} AND {T0 + 30 * DAY}
AND service <> 'view' AND host IN (1, 2, 3) AND message IS NOT NULL AND starts_with(message, 'pur') AND contains(lower(message), 'k": 1')""")
def f10(spark, sf):
    r = s.LogRequest(T0, T0 + 30 * DAY, filters=[("service", "neq", ["view"]), ("host", "in", [1, 2, 3]), ("message", "exists", []), ("message", "prefix", ["pur"]), ("message", "eq", ['K": 1'])])
    return logs(spark, sf).where(r.validate().condition())


@query("f11_unset_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE coalesce(nullif(c_mktsegment, 'MACHINERY'), '') = ''")
def f11(spark, sf):
    c = read(spark, sf, "customer").withColumn("env", F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")))
    return c.where(s.unset_is("env", "")).select("c_custkey", "c_mktsegment")


@query("f12_keywords", f"""WITH {LOGS_SQL} SELECT {LOGCOLS} FROM logs WHERE t BETWEEN {T0} AND {T0 + 30 * DAY}
AND (contains(lower(message), 'click') OR contains(lower(message), 'error')) AND NOT contains(lower(message), '"k": 7')""")
def f12(spark, sf):
    return logs(spark, sf).where(s.LogRequest(T0, T0 + 30 * DAY, include=["CLICK", "error"], exclude=['"k": 7']).validate().condition())


@query("f12_keywords_all", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license')")
def f12b(spark, sf):
    return read(spark, sf, "documents").where(s.like_any(["text"], "the") & s.like_any(["text"], "license")).select("doc_id")


@query("f14_portable_log_query", f"""WITH {LOGS_SQL} SELECT {LOGCOLS} FROM logs WHERE service IN ('view', 'click') AND contains(message, 'k') AND NOT contains(message, ': 5')
AND (contains(lower(message), '1') OR contains(lower(message), '2'))""")
def f14(spark, sf):
    return logs(spark, sf).where(s.log_query('{service=~"view|click"} |= "k" != ": 5" |~ "(?i)1|2"'))


@query("f15_log_metric_form", f"WITH {LOGS_SQL} SELECT service, count(*) AS n FROM logs WHERE service <> 'view' AND (contains(message, '1') OR contains(message, '9')) AND t > {T0 + 3 * DAY} AND t <= {T0 + 4 * DAY} GROUP BY service")
def f15(spark, sf):
    d = logs(spark, sf).where(s.log_query('{service!="view"} |~ "1|9"') & (F.col("t") > T0 + 3 * DAY) & (F.col("t") <= T0 + 4 * DAY))
    return d.groupBy("service").agg(F.count(F.lit(1)).alias("n"))


@query("f16_span_predicates", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND length(text) * 1000 >= 200000")
def f16(spark, sf):
    c = read(spark, sf, "conversations").withColumn("resource", F.create_map(F.lit("service.name"), F.col("role"))).withColumn("start_ns", F.lit(0)).withColumn("end_ns", F.length("text") * 1000)
    return c.where(s.span_query(service="assistant", environment="", min_ns=200_000)).select("conv_id", "turn")


@query("f17_span_device_scope", "SELECT conv_id, turn FROM conversations WHERE (conv_id % 5)::VARCHAR IN ('1', '2')")
def f17(spark, sf):
    c = read(spark, sf, "conversations").withColumn("resource", F.create_map(F.lit("device_id"), (F.col("conv_id") % 5).cast("string")))
    return c.where(s.span_query(devices=["1", "2"])).select("conv_id", "turn")


@query("f18_run_post_filter", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING list_contains(list(DISTINCT role), 'system') AND contains(lower(min(CASE WHEN turn = 0 THEN text END)), 'th')")
def f18(spark, sf):
    runs = read(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"), F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("first"))
    return runs.where(F.array_contains("roles", "system") & s.like_any(["first"], "TH")).select("conv_id")


@query("f19_sql_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 90000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1997-01-01'")
def f19(spark, sf):
    o = read(spark, sf, "orders")
    return o.where((F.col("o_orderstatus") == "F") & F.col("o_totalprice").between(1000, 90000) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("f20_multi_column_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a1') OR contains(lower(p_brand), '#12') OR contains(lower(p_type), 'brass')")
def f20(spark, sf):
    p = read(spark, sf, "part")
    return p.where(s.like_any(["p_name"], "A1") | s.like_any(["p_brand"], "#12") | s.like_any(["p_type"], "BRASS")).select("p_partkey")


_LEVEL = "CASE WHEN value > 200 THEN 'critical' WHEN value > 100 THEN 'error' WHEN value > 50 THEN 'warning' ELSE 'info' END"


@query("f21_severity_floor", f"SELECT event_id, {_LEVEL} AS severity FROM events WHERE {_LEVEL} IN ('error', 'critical')")
def f21(spark, sf):
    v = F.col("value")
    sev = F.when(v > 200, "critical").when(v > 100, "error").when(v > 50, "warning").otherwise("info")
    return read(spark, sf, "events").select("event_id", sev.alias("severity")).where(s.severity_floor("severity", "error"))


@query("f22_vector_payload_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2') AND starts_with(text, 'T')")
def f22(spark, sf):
    d = read(spark, sf, "documents")
    tagged = d.withColumn("tags", F.array("source", "lang"))
    return tagged.where((F.col("lang") == "en") & F.arrays_overlap("tags", F.array(F.lit("src1"), F.lit("src2"))) & F.col("text").startswith("T")).select("doc_id")


@query("f23_flow_condition", "SELECT event_id FROM events WHERE TRY_CAST(props->>'$.k' AS DOUBLE) >= 50")
def f23(spark, sf):
    return read(spark, sf, "events").where(s.flow_condition("{{k}} >= 50", "props")).select("event_id")


@query("f24_template_projection", "SELECT event_id, 'k=' || coalesce(props->>'$.k', '') || ';' || coalesce(props->>'$.none', '') AS text, props->>'$.k' AS whole FROM events")
def f24(spark, sf):
    return read(spark, sf, "events").select("event_id", s.template("k={{ k }};{{none}}", "props").alias("text"), s.template("{{k}}", "props").alias("whole"))


@query("f25_argument_coercion", "SELECT event_id, TRY_CAST(props->>'$.k' AS BIGINT) AS k, TRY_CAST(event_type AS BIGINT) IS NULL AS bad, (props->>'$.k') IN ('1', 'true') AS flag FROM events")
def f25(spark, sf):
    k = F.get_json_object("props", "$.k")
    return read(spark, sf, "events").select("event_id", k.try_cast("long").alias("k"), F.col("event_type").try_cast("long").isNull().alias("bad"), k.isin("1", "true").alias("flag"))


@query("f26_trigger_match", f"SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') AND {_LEVEL} IN ('warning', 'critical') GROUP BY event_type")
def f26(spark, sf):
    v = F.col("value")
    sev = F.when(v > 200, "critical").when(v > 100, "error").when(v > 50, "warning").otherwise("info")
    return read(spark, sf, "events").where(F.col("event_type").isin("error", "signup") & sev.isin("warning", "critical")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("f27_column_pruning", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45")
def f27(spark, sf):
    return read(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber")


@query("f28_compact_projection", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text, source || '|' || lang AS labels FROM documents")
def f28(spark, sf):
    labels = F.create_map(F.lit("source"), F.col("source"), F.lit("noise"), F.lit("x"), F.lit("lang"), F.col("lang"))
    kept = F.map_filter(labels, lambda k, v: k != "noise")
    short = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", short.alias("text"), F.concat_ws("|", kept["source"], kept["lang"]).alias("labels"))


@query("f29_label_drop", f"WITH {SAMPLES_SQL} SELECT 'host=' || host || ',name=' || name AS series, count(*) AS n FROM samples GROUP BY 1")
def f29(spark, sf):
    from opsframe.operators.vector import series_key

    labels = F.create_map(F.lit("name"), F.col("name"), F.lit("host"), F.col("host").cast("string"), F.lit("instance"), F.col("t").cast("string"))
    return samples(spark, sf).groupBy(series_key(labels, ["instance"]).alias("series")).agg(F.count(F.lit(1)).alias("n"))


@query("f30_filesystem_dedupe", """WITH m AS (SELECT p_partkey, p_brand AS device, p_type AS mount FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY (mount <> '/')::INT, length(mount), mount, p_partkey) AS n FROM m WHERE starts_with(device, 'Brand#1'))
SELECT p_partkey, device, mount FROM r WHERE n = 1 UNION ALL SELECT p_partkey, device, mount FROM m WHERE NOT starts_with(device, 'Brand#1')""")
def f30(spark, sf):
    from opsframe.sources.upsert import latest

    m = read(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("device"), F.col("p_type").alias("mount"))
    physical = F.col("device").startswith("Brand#1")
    best = latest(m.where(physical), ["device"], [(F.col("mount") != "/").cast("int"), F.length("mount"), F.col("mount"), F.col("p_partkey")])
    return best.unionByName(m.where(~physical))
