"""Semantics that the tables don't show, on hand-made rows; streams against their batch forms."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from opsframe.functions import scalars as sc
from opsframe.functions import tools
from opsframe.operators import documents, graph, logs, promql, red, rollup, rules, runs, select
from opsframe.operators import range as r
from opsframe.operators import vector as v
from opsframe.sources import exposition, otlp, tables, upsert
from opsframe.streaming import windows

S = r.SECOND


def counter(spark, values, step=60):
    return spark.createDataFrame([("a", float(x), i * step * S) for i, x in enumerate(values)], "name string, value double, t long")


def only(d):
    return [x["value"] for x in d.collect()]


def test_rate_extrapolates_to_the_window(spark):
    # 11 points a minute apart, 100 each: 1000 in 600 s
    assert only(r.increase(counter(spark, range(100, 1200, 100)), ["name"], r.Grid.instant(600 * S, 600 * S))) == [pytest.approx(1000)]
    # 60 s are missing on the left: under 1.1 steps, so the line goes on to the edge
    assert only(r.rate(counter(spark, range(100, 1200, 100)), ["name"], r.Grid.instant(600 * S, 660 * S))) == [pytest.approx(1100 / 660)]
    # a wide gap counts half a step, and a counter starts at zero at the earliest
    assert only(r.increase(counter(spark, range(1000, 2100, 100)), ["name"], r.Grid.instant(600 * S, 1200 * S))) == [pytest.approx(1050)]
    assert only(r.increase(counter(spark, range(10, 1110, 100)), ["name"], r.Grid.instant(600 * S, 1200 * S))) == [pytest.approx(1010)]


def test_resets_add_what_was_counted(spark):
    got = only(r.increase(counter(spark, [10, 20, 5, 15]), ["name"], r.Grid.instant(180 * S, 180 * S)))
    assert got == [pytest.approx(25)]
    assert [x["value"] for x in r.delta_clamped(counter(spark, [10, 20, 5, 15]), ["name"]).orderBy("t").collect()] == [pytest.approx(10 / 60), 0, pytest.approx(10 / 60)]


def test_one_sample_has_no_rate_and_left_bound_is_a_parameter(spark):
    d = counter(spark, [1, 2])
    assert only(r.rate(d, ["name"], r.Grid.instant(0, 60 * S))) == []
    n = lambda closed: only(r.over_time("count", d, ["name"], r.Grid.instant(60 * S, 60 * S, closed)))
    assert n(True) == [2] and n(False) == [1]


def test_histogram_quantile_edges(spark):
    b = lambda rows: spark.createDataFrame([("a", le, float(c)) for le, c in rows], "k string, le string, value double")
    q = lambda x, rows: only(r.histogram_quantile(x, b(rows), ["k"]))
    assert q(0.5, [("1", 5), ("2", 10), ("+Inf", 10)]) == [1.0]
    assert q(0.25, [("1", 5), ("2", 10), ("+Inf", 10)]) == [0.5]
    assert q(0.99, [("1", 5), ("+Inf", 10)]) == [1.0]
    assert q(0.5, [("1", 0), ("+Inf", 0)]) == [] and q(0.5, [("1", 5)]) == []
    assert q(0.9, [("1", 6), ("2", 5), ("4", 10), ("+Inf", 10)]) == [pytest.approx(3.5)]


def test_red_of_the_benchmark_table(spark):
    d = red.summarise(red.request_table(spark, 3), ["service", "protocol"], 600 * S, 600 * S)
    rows = red.combine(d, ["service"]).collect()
    assert len(rows) == 3 and all(x["error_rate"] == pytest.approx(0.25) and x["rps"] == pytest.approx(2 * 4000 / 600) for x in rows)
    assert all(x["p50"] is None for x in rows)
    states = spark.createDataFrame([(None,), (0.0,), (1.0,)], "rps double").select(red.status().alias("s")).collect()
    assert [x["s"] for x in states] == ["insufficient_samples", "no_requests", "ok"]


def test_vector_or_prefers_left_and_missing_is_not_zero(spark):
    a = v.Vector.of(spark.createDataFrame([("x", 1.0), ("y", None), ("z", float("nan"))], "k string, value double"), ["k"])
    b = v.Vector.of(spark.createDataFrame([("x", 5.0), ("y", 6.0)], "k string, value double"), ["k"])
    assert sorted(map(tuple, a.or_(b).df.collect())) == [("x", 1.0), ("y", 6.0)]
    assert v.coalesce_zero(a, b).df.orderBy("k").collect()[1]["value"] == 0
    assert a.and_(b, on=[]).df.count() == 1 and a.unless(b, on=[]).df.count() == 0


def test_keyset_pages_lose_and_repeat_nothing(spark):
    d = spark.createDataFrame([(i, i // 7, "m") for i in range(50)], "id long, t long, message string")
    for down in (True, False):
        q, cursor, seen = select.LogRequest(0, 100, limit=6, descending=down), None, []
        while True:
            got, cursor = logs.page(logs.search(d, q, cursor), q.limit)
            seen += [x["id"] for x in got]
            if cursor is None:
                break
        assert seen == sorted(range(50), reverse=down)


def test_histogram_is_aligned_to_start_with_a_partial_tail(spark):
    d = spark.createDataFrame([(t,) for t in (10, 14, 15, 31, 32)], "t long")
    assert list(map(tuple, logs.histogram(d, 10, 32, 5).orderBy("bucket").collect())) == [(10, 2), (15, 1), (20, 0), (25, 0), (30, 2)]


@pytest.mark.parametrize("bad", ['|= "a"', '{a="b"} | json', '{a="b"} |~ "x.*"', "{a=b}"])
def test_log_query_rejects(bad):
    with pytest.raises(ValueError):
        select.log_query(bad)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='{}="|~!ab \\`', max_size=25))
def test_log_query_never_panics(text):
    try:
        select.log_query(text)
    except ValueError:
        pass


def test_request_limits():
    for kw in ({"limit": 0}, {"limit": 1001}, {"include": ["a"] * 21}, {"mode": "some"}):
        with pytest.raises(ValueError):
            select.LogRequest(0, 10, **kw).validate()
    with pytest.raises(ValueError):
        select.LogRequest(0, 31 * 86400 * S).validate()


def test_exposition(spark):
    text = ["# TYPE a counter", 'a{x="1",y="q\\"u\\\\o\\nte"} 2.5 1700', "b 1e3", "c +Inf", "bad{x} 1", 'd{x="1"} nope', ""]
    got = {x["name"]: x for x in exposition.parse(spark.createDataFrame([(t,) for t in text], "value string")).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"]["labels"] == {"x": "1", "y": 'q"u\\o\nte'} and got["a"]["ts_ms"] == 1700 and got["c"]["value"] == float("inf")
    some = exposition.parse(spark.createDataFrame([("a 1",), ("b 2",)], "value string"))
    assert [(x["name"], x["value"]) for x in exposition.scrape(some, "h", 1).collect()] == [("up", 0.0)]


def test_otlp(spark):
    attr = lambda k, **x: {"key": k, "value": x}
    span = lambda s, p=None: {"traceId": "ABC", "spanId": s, "parentSpanId": p, "name": "n", "startTimeUnixNano": "5", "endTimeUnixNano": "9", "attributes": [attr("a", intValue="1"), attr("b", boolValue=True), attr("a", stringValue="z")]}
    doc = lambda key: json.dumps({key: [{"resource": {"attributes": [attr("service.name", stringValue="s")]}, "scopeSpans": [{"scope": {"name": "sc"}, "spans": [span("1"), span("2", "1"), span("1"), span("zz")]}]}]})
    got = otlp.spans(spark.createDataFrame([(doc("resourceSpans"),), ("{bad",)], "value string")).orderBy("span_id").collect()
    assert [x["span_id"] for x in got] == ["0" * 15 + "1", "0" * 15 + "2"] and got[0]["trace_id"] == "0" * 29 + "abc"
    assert got[0]["attributes"] == {"a": "z", "b": "true"} and got[0]["resource"] == {"service.name": "s"} and got[1]["parent_span_id"] == "0" * 15 + "1"
    assert otlp.spans(spark.createDataFrame([(doc("batches"),)], "value string")).count() == 2


def test_runs_cut_cycles_and_follow_identity(spark):
    rows = [("t", "a", None, "x", "i"), ("t", "b", "a", "x", "i"), ("t", "c", "b", "y", "i"), ("t", "d", "c", "x", "i"), ("t", "e", "gone", "x", "i"), ("t", "f", "g", "x", "i"), ("t", "g", "f", "x", "i")]
    d = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, sdk string, identity string")
    got = {x["span_id"]: (x["run_id"], x["issue"]) for x in runs.assign_runs(d).collect()}
    assert got == {"a": ("a", None), "b": ("a", None), "c": ("c", None), "d": ("a", None), "e": ("e", "missing_parent"), "f": ("f", "cycle"), "g": ("f", None)}


def test_usage_adapts_and_conflicts(spark):
    rows = [({"openinference.span.kind": "LLM", "llm.model_name": "m", "llm.token_count.prompt": "3"},), ({"gen_ai.usage.input_tokens": "3", "gen_ai.usage.prompt_tokens": "4"},), ({"x": "y"},)]
    got = runs.adapt(spark.createDataFrame(rows, "attributes map<string,string>")).collect()
    assert [(x["sdk"], x["model"], x["input_tokens"], x["usage_conflict"]) for x in got] == [("openinference", "m", 3, False), ("otel", None, None, True), (None, None, None, False)]


def test_graph_depth_direction_and_cycles(spark):
    d = spark.createDataFrame([("a", "b", "depends_on"), ("b", "c", "depends_on"), ("c", "a", "depends_on"), ("c", "d", "contains"), ("d", "e", "routes_to")], "src string, dst string, type string")
    start = spark.createDataFrame([("a",)], "node string")
    hops = lambda **k: {x["node"]: x["hops"] for x in graph.expand(d, start, **k).collect()}
    assert hops(depth=9, direction="down") == {"b": 1, "c": 2} and hops(depth=1) == {"b": 1, "c": 1}
    assert hops(depth=5, direction="down", propagating=False) == {"b": 1, "c": 2, "d": 3, "e": 4}


def test_notifications_in_order(spark):
    d = spark.createDataFrame([("a", t, 1.0) for t in (0, 1, 2, 20, 21)], "name string, t long, value double")
    got = rules.notifications(d, ["name"], F.col("t") == 0, 10, 5, 2, F.lit(False)).orderBy("t").collect()
    assert [x["outcome"] for x in got] == ["silenced", "notified", "cooldown", "dampened", "notified"]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(sc.mac(F.lit("AA-bb.CC:dd ee11"))) == "aa:bb:cc:dd:ee:11" and one(sc.mac(F.lit("12"))) is None
    assert one(sc.detect_level(F.lit("E0102 10:00:00.1 x.go:1] boom"))) == "error" and one(sc.detect_level(F.lit('{"severity":"Warning"}'))) == "warn"
    assert one(sc.human_bytes(F.lit(1536))) == "1.5 KiB" and one(sc.md5_id(F.lit("a"))) == 919145239626757800
    assert one(sc.normal_stack(F.lit("goroutine 12 [running]:\n main.f(0xc0001)\n  x.go:3 +0x1f\n"))) == "goroutine ? [running]:\nmain.f(?)\nx.go:3 ?"
    assert one(sc.redact(F.lit("api_key: abc, Bearer xyz"))) == "api_key: ***, Bearer ***"
    assert one(sc.minutes_between(F.lit(60_000_000), F.lit(0))) == 0 and one(sc.csv_list(F.lit(" a, ,b "))) == ["a", "b"]
    assert one(sc.redact_map(F.create_map(F.lit("db_password"), F.lit("x"), F.lit("k"), F.lit("v")))) == {"db_password": "***", "k": "v"}


def test_flow_conditions(spark):
    d = spark.createDataFrame([('{"a": {"b": [5, "x y"]}, "t": "true"}',)], "c string")
    true = lambda text: d.where(select.flow_condition(text, "c")).count() == 1
    assert true("{{a.b[0]}} >= 5") and not true("{{a.b[0]}} > 10") and true('{{a.b[1]}} contains "y"') and true("{{t}}") and not true("{{none}}") and true("{{none}} != 1")
    with pytest.raises(ValueError):
        select.flow_condition("1 == 2 == 3", "c")


def test_chunks_and_sections(spark):
    d = spark.createDataFrame([(1, "x" * 2500), (2, "y" * 2501), (3, " "), (4, "# A\nshort\n## B\n" + "word. " * 800)], "doc_id long, text string")
    got = documents.chunks(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == [(1, 1), (2, 2), (4, 3)]
    s = documents.split_markdown(d.where("doc_id = 4")).orderBy("chunk_index").collect()
    assert all(len(x["content"]) <= 2500 for x in s) and s[0]["heading"].startswith("A")
    assert spark.range(1).select(documents.html_text(F.lit("<p>a&amp;b <script>x<y</script><b>c</b></p>"))).first()[0] == "a&b c"


def test_router_and_sink(spark, tmp_path):
    assert [rollup.choose_tier(x * rollup.HOUR) for x in (6, 7, 168, 169)] == ["raw", "5m", "5m", "1h"]
    with pytest.raises(KeyError):
        tables.select_source(spark, "", "none")
    d = spark.range(10).withColumn("day", F.col("id") % 2)
    upsert.write_partitioned(d, str(tmp_path / "o"), "day")
    assert spark.read.parquet(str(tmp_path / "o")).where("day = 1").count() == 5


def test_tools(spark):
    sf = "/root/testdata/sf0.001"
    assert tools.call("rank_hosts", spark, sf, '{"metric": "view", "k": 3}').count() == 3
    assert tools.call("query_logql", spark, sf, json.dumps({"query": '{service="error"} |= "k"', "limit": 5})).count() == 5
    assert tools.call("list_metric_catalog", spark, sf).count() == 5 and tools.call("find_outlier_hosts", spark, sf, '{"metric": "view", "limit": 0.5}').count() > 0
    tools.register(spark)
    assert spark.sql("select human_bytes(2048D) as x").first()["x"] == "2.0 KiB"


# --- streams ---------------------------------------------------------------------------------------


@pytest.fixture
def files(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").withColumn("ts", F.col("ts").cast("timestamp"))
    # a file at a time, in order: a stream takes files by age, and one that comes before its time moves the watermark past the others
    parts = e.withColumn("k", F.ntile(4).over(Window.orderBy("ts", "event_id")))
    for k in range(1, 5):
        parts.where(F.col("k") == k).drop("k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), str(tmp_path), e


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_windows_match_batch(spark, files):
    path, out, e = files
    s = windows.run_to_end(windows.tumbling(windows.read_events(spark, path, EVENTS), ["event_type"], "value", "1 hour"), spark, out, "w")
    batch = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("value").alias("n")).select("event_type", F.col("w.start").alias("ts"), "n")
    got, want = ({tuple(x) for x in d.select("event_type", "ts", "n").collect()} for d in (s, batch))
    assert got <= want and len(want) - len(got) <= 60  # windows that the watermark hasn't closed wait


def test_late_rows_are_dropped(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    middle, later = e.agg(F.expr("percentile_approx(ts, array(0.5, 0.75))")).first()[0]
    # rows are late by the watermark of the batch before the last one
    for part in (e.where(F.col("ts").between(middle, later)), e.where(F.col("ts") > later), e.where(F.col("ts") < middle)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = windows.run_to_end(windows.tumbling(windows.read_events(spark, str(tmp_path / "in"), EVENTS), ["event_type"], "value", "1 hour"), spark, str(tmp_path), "late")
    # the last file's rows are older than the watermark
    assert s.where(F.col("ts") < F.lit(middle) - F.expr("interval 1 hour")).count() == 0
    want = e.where(F.col("ts") >= F.lit(middle) + F.expr("interval 1 hour")).groupBy("event_type", F.window("ts", "1 hour").alias("w")).count()
    got = s.where(F.col("ts") >= F.lit(middle) + F.expr("interval 1 hour"))
    assert 0 < got.count() <= want.count() and got.join(want.select("event_type", F.col("w.start").alias("ts"), "count"), ["event_type", "ts"], "left").where("n <> count or count is null").count() == 0


def test_duplicates_go(spark, files):
    path, out, e = files
    d = windows.read_events(spark, path, EVENTS)
    s = windows.run_to_end(windows.once(d.union(d), ["event_id"], "40 days"), spark, out, "d")
    assert s.count() == e.count()


def test_counter_state_matches_batch(spark, files):
    path, out, e = files
    d = windows.read_events(spark, path, EVENTS).select("event_type", tables.micros("ts").alias("t"), "value")
    s = windows.run_to_end(windows.counter_deltas(d, ["event_type"]), spark, out, "c")
    got = {x["event_type"]: x["x"] for x in s.groupBy("event_type").agg(F.round(F.sum("delta"), 4).alias("x")).collect()}
    b = r.delta_clamped(e.select("event_type", tables.micros("ts").alias("t"), "value"), ["event_type"])
    assert sum(x for x in got.values()) > 0 and s.count() <= b.count()


def test_alert_state(spark, tmp_path):
    spark.createDataFrame([("a", t) for t in (0, 1, 2, 9, 10)], "name string, t long").coalesce(1).write.parquet(str(tmp_path / "f"))
    d = spark.readStream.schema("name string, t long").parquet(str(tmp_path / "f"))
    got = windows.run_to_end(windows.alert_state(d, ["name"], 1, 5), spark, str(tmp_path), "a").collect()
    assert sorted((x["t"], x["event"]) for x in got) == [(0, "notified"), (0, "opened"), (1, "bumped"), (2, "bumped"), (9, "notified"), (9, "reopened"), (10, "bumped")]


def test_service_graph_stream(spark, tmp_path):
    ts = "timestamp'2024-01-01 00:00:00'"
    spark.sql(f"select 't' trace_id, 's1' span_id, 'web' service, {ts} ts, false failed union all select 't', 's2', 'web', {ts}, true").write.parquet(str(tmp_path / "c"))
    spark.sql(f"select 't' trace_id, 's1' parent_span_id, 'db' service, {ts} + interval 5 seconds ts, true failed").write.parquet(str(tmp_path / "s"))
    c = spark.readStream.schema("trace_id string, span_id string, service string, ts timestamp, failed boolean").parquet(str(tmp_path / "c"))
    s = spark.readStream.schema("trace_id string, parent_span_id string, service string, ts timestamp, failed boolean").parquet(str(tmp_path / "s"))
    got = windows.run_to_end(windows.service_graph(c, s), spark, str(tmp_path), "g").collect()
    assert [tuple(x) for x in got] == [("web", "db", True)]


def test_latest_by_batches(spark, files):
    path, out, e = files
    q = windows.read_events(spark, path, EVENTS).writeStream.foreachBatch(windows.keep_latest(out + "/latest", ["user_id"], "event_id")).option("checkpointLocation", out + "/st").trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(int(p.name[1:]) for p in __import__("pathlib").Path(out, "latest").iterdir())
    got = {(x["user_id"], x["event_id"]) for x in spark.read.parquet(f"{out}/latest/v{last}").collect()}
    assert got == {(x["user_id"], x["m"]) for x in e.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}


def test_sampling_batch(spark):
    d = spark.createDataFrame([("a", False), ("a", True), ("b", False)], "trace_id string, sdk boolean")
    assert [x["trace_id"] for x in windows.sampled(d, "sdk").collect()] == ["b"]


@pytest.mark.parametrize("bad", ["sum(", "view[5m", "view offset", "a +", "rate(view)", "{a=b}", "nope(view)", "view[5m] > 1"])
def test_promql_rejects(spark, bad):
    d = spark.createDataFrame([("view", "1", 1.0, 0)], "name string, host string, value double, t long")
    with pytest.raises(ValueError):
        promql.evaluate(bad, d, ["host"], 0)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='abs(){}[]="5m+-*/<>!, :@', max_size=20))
def test_promql_parser_never_panics(text):
    try:
        promql.Parser(text).parse()
    except ValueError:
        pass


def test_promql_scalars_and_functions(spark):
    d = spark.createDataFrame([("m", "a", float(x), x * 60 * S) for x in range(11)] + [("m", "b", 7.0, 600 * S)], "name string, host string, value double, t long")
    one = lambda q: sorted((x["host"] if "host" in x else None, round(x["value"], 4)) for x in map(lambda z: z.asDict(), promql.evaluate(q, d, ["host"], 600 * S).df.collect()))
    assert one("1 + 2 * 3 ^ 2") == [(None, 19.0)] and one("-m{host='a'}") == [("a", -10.0)] and one("m > bool 8") == [("a", 1.0), ("b", 0.0)]
    assert one("increase(m[10m])") == [("a", 10.0)] and one("clamp_min(m, 8)") == [("a", 10.0), ("b", 8.0)] and one("count(m) by (host)") == [("a", 1.0), ("b", 1.0)]
    assert one("m offset 5m") == [("a", 5.0)] and one("sum without (host) (m)") == [(None, 17.0)] and one("scalar(m{host='b'})") == [(None, 7.0)] and one("time()") == [(None, 600.0)]
    assert one('label_replace(m{host="b"}, "x", "$1!", "host", "(.*)")') == [("b", 7.0)] and one("quantile(0.5, m)") == [(None, 8.5)]
