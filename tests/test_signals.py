"""Error groups, findings, specs, batches and streams, by hand and against plain loops."""

import pytest
from pyspark.sql import functions as F

from opsframe.operators import errors, findings, graph, ingest, logs, select, specs
from opsframe.operators import range as r
from opsframe.streaming import windows


def test_stack_keys(spark):
    go = "goroutine 7 [running]:\n  a.b(0x1, 0x2)\n\tmain.go:12 +0x1f\n\ncreated by x.y in goroutine 3\n"
    rows = [(1, go), (2, go.replace("7 [", "99 [").replace("0x1", "0xabc").replace("+0x1f", "+0x2")), (3, go.replace("main.go:12", "main.go:13")), (4, "Traceback at 0x1"), (5, "Traceback at 0x2"), (6, None)]
    got = {x["i"]: x["k"] for x in spark.createDataFrame(rows, "i int, s string").select("i", errors.stack_key(F.col("s")).alias("k")).collect()}
    assert got[1] == "a.b\nmain.go:12\ncreated by x.y" and got[2] == got[1] and got[3] != got[1] and got[4] != got[5] and got[6] is None


def test_error_groups_count_a_span_once(spark):
    rows = [("GET /", "E", "500", "s", 5, "v2", "i1", "t1", "a"), ("GET /", "E", "500", "s", 5, "v2", "i1", "t1", "a"), ("GET /", "E", "500", "s", 9, "v1", "i2", "t2", "b"), ("GET /", "E", "502", "s", 1, None, "i2", "t3", "c")]
    got = sorted(errors.groups(spark.createDataFrame(rows, "operation string, error_type string, status string, stack string, t long, version string, instance string, trace_id string, span_id string")).collect(), key=lambda x: -x["n"])
    assert [(x["n"], x["first_seen"], x["last_seen"], x["versions"], x["instances"], x["span_id"]) for x in got] == [(2, 5, 9, "v1,v2", "i1,i2", "b"), (1, 1, 1, "", "i2", "c")]


def test_findings(spark):
    rows = [("db", "a", t * 60_000_000, float(v)) for t, v in enumerate([1, 2, 1, 4])] + [("db", "g", 60_000_000, 80.0), ("db", "g", 120_000_000, 90.0)]
    checks = [
        findings.Check("growth", "a", "increase", warning_above=1), findings.Check("top", "g", "max", critical_above=95, warning_above=85), findings.Check("low", "g", "avg", critical_below=86, warning_above=1),
        findings.Check("share", "a", "percent", of="a", critical_above=99), findings.Check("absent", "x", "max", warning_above=0),
    ]
    got = {x["check"]: (round(x["value"], 3), x["severity"]) for x in findings.findings(spark.createDataFrame(rows, "db string, name string, t long, value double"), ["db"], checks, 180_000_000, 180_000_000).collect()}
    assert set(got) == {"growth", "top", "low", "share"} and got["top"] == (90.0, "warning") and got["low"] == (85.0, "critical") and got["share"] == (100.0, "critical")
    assert got["growth"][0] == pytest.approx(5.0, abs=0.01) and got["growth"][1] == "warning"


def test_specs(spark):
    rows = [("", {"slo": "0.999", "sli": "x"}), (None, {"slo": "99.5"}), ("metric_forecast", {"operator": "GE"}), ("", {"other": "1"}), ("log_match", {"threshold": " "}), ("", None)]
    got = [(x["kind"], x["spec"]) for x in specs.normalise(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, kind string, spec map<string,string>")).orderBy("i").collect()]
    assert got[0] == ("metric_burn_rate", {"slo": "99.9", "sli": "x"}) and got[1] == ("metric_burn_rate", {"slo": "99.5"})
    assert got[2] == ("metric_forecast", {"operator": ">=", "fit_window": "1h", "predict_seconds": "21600"}) and got[3] == ("", {"other": "1"})
    assert got[4] == ("log_match", {"threshold": "1", "window": "5m", "operator": ">=", "stream_selector": '{source=~"journald(:.*)?"}'}) and got[5] == ("", {})


def test_logical_fields():
    assert select.logical_filters([("level", "eq", ["x"])], {"level": "severity_text"}) == [("severity_text", "eq", ["x"])]
    for name, columns in (("password", {"password": "p"}), ("pod", {"level": "severity_text"})):
        with pytest.raises(ValueError):
            select.logical_filters([(name, "eq", ["x"])], columns)


def test_byte_batches_match_a_loop(spark):
    rows = [(("a", "b", None)[i % 3], i, "x" * ((i * 37) % 90)) for i in range(400)] + [("a", 1000, "y" * 500)]
    got = ingest.batches(spark.createDataFrame(rows, "s string, i long, v string"), "s", ["i"], F.length("v"), 7, 200, 10).collect()
    want = {}
    for s in ("a", "b", None):
        batch, n, used = 0, 0, 10
        for _, i, v in sorted((x for x in rows if x[0] == s), key=lambda x: x[1]):
            if 10 + len(v) > 200:
                want[i] = None
                continue
            if n and (n >= 7 or used + 1 + len(v) > 200):
                batch, n, used = batch + 1, 0, 10
            used, n = used + len(v) + (1 if n else 0), n + 1
            want[i] = batch
    assert {x["i"]: x["batch"] for x in got} == want


def test_hit_order_and_empty(spark):
    hits = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "node string, hops int")
    names = spark.createDataFrame([("a", "A"), ("b", "Z"), ("c", "Y")], "node string, name string")
    assert [(x["place"], x["node"]) for x in graph.ordered(hits, names).collect()] == [(1, "c"), (2, "b"), (3, "a")]
    assert graph.ordered(hits.limit(0), names).count() == 0


def test_text_lines(spark):
    got = logs.parse_lines(spark.createDataFrame([("2024-01-01T00:00:01.5Z ERROR  it broke",), ("plain",), (None,)], "value string")).collect()
    assert (got[0]["t"], got[0]["severity_text"], got[0]["message"]) == (1704067201500000, "error", "it broke") and tuple(got[1]) == (None, None, "plain") and tuple(got[2]) == (None, None, None)


def test_dampening_and_cooling_over_batches(spark, tmp_path):
    for k, ts in enumerate(([1, 2, 3], [4, 30, 31, 32, 33])):
        spark.createDataFrame([("a", t) for t in ts], "k string, t long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, t long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = windows.run_to_end(windows.dampened(s, ["k"], 5, 3, 20), spark, str(tmp_path), "d").orderBy("t").collect()
    assert [(x["t"], x["event"]) for x in got] == [(1, "dampened"), (2, "dampened"), (3, "notified"), (4, "cooling"), (30, "dampened"), (31, "dampened"), (32, "notified"), (33, "cooling")]


def test_range_step():
    assert r.range_step(3600) == (30.0, 300.0) and r.range_step(86_400) == (360.0, 1440.0)


def test_streams_and_enrichment_of_nothing(spark):
    none = spark.createDataFrame([], "id long, t long, service string, host long, severity_text string, message string")
    assert logs.streams(none, select.LogRequest(start=0, end=10), ["service"]).count() == 0
    e = spark.createDataFrame([(None,), ({"deployment.environment.name": ""},)], "resource map<string,string>")
    assert [x["resource"] for x in ingest.enrich(e, {"deployment.environment.name": "p"}).collect()] == [None, {"deployment.environment.name": "p"}]
