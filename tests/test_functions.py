"""Table functions in SQL and helpers of another program: wrong arguments, odd rows, helpers that hang, die or talk too much."""

import json
import sys
import time

import pytest
from pyspark.errors import AnalysisException

from opsframe.functions import external, table_functions

SAMPLES = "name string, host string, t long, value double"


def tables(spark):
    rows = [("up", "a", 10, 1.0), ("up", "a", 20, 2.0), ("up", "a", 30, None), ("up", None, 15, 3.0), ("up", "b", 400, 4.0), ("down", "a", 20, 5.0), (None, "a", 20, 6.0)]
    logs = [(1, 5, "s", "a", "info", "An Error"), (2, 15, "s", "a", "warn", "fine"), (3, 16, "s", "a", None, "error")]
    table_functions.register(spark, spark.createDataFrame(rows, SAMPLES), spark.createDataFrame(logs, "id long, t long, service string, host string, severity_text string, message string"))


def ask(spark, selector, at, *more):
    return sorted((tuple(r) for r in spark.sql(f"SELECT * FROM instant_selector(TABLE(samples), '{selector}', {', '.join(map(str, (at, *more)))})").collect()), key=str)


def test_instant_selector(spark):
    tables(spark)
    assert ask(spark, "up", 30) == [("up", "a", 2.0), ("up", None, 3.0)]
    assert ask(spark, "up", 25, 4) == [] and ask(spark, "up", 25, 5) == [("up", "a", 2.0)]
    assert ask(spark, 'up{host=""}', 30) == [("up", None, 3.0)] and ask(spark, '{host!="",name!~"u.*|"}', 30) == [("down", "a", 5.0)]
    assert ask(spark, '{host=~"a|b"}', 400) == [("down", "a", 5.0), ("up", "a", 2.0), ("up", "b", 4.0), (None, "a", 6.0)]
    assert spark.sql("SELECT * FROM instant_selector(TABLE(samples), 'up', 30)").columns == ["name", "host", "value"]


@pytest.mark.parametrize("call", ["TABLE(samples), 'up{', 30", "TABLE(samples), 'up{zone=\"x\"}', 30", "'samples', 'up', 30", "TABLE(logs), 'up', 30", "TABLE(samples), NULL, 30", "TABLE(samples), 'up'"])
def test_instant_selector_says_what_is_wrong(spark, call):
    tables(spark)
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM instant_selector({call})").collect()


def test_sql_tools(spark):
    tables(spark)
    rows = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert rows("SELECT name, series, last FROM metric_catalog('p')") == [("up", 2, 400)]
    assert sorted(rows("SELECT start, level, n FROM log_counts('ERROR', 10)"), key=str) == [(0, "info", 1), (10, None, 1)]


HELPER = """import json, os, sys, time
for line in sys.stdin:
    r = json.loads(line)
    k = r["k"]
    if k == "die": os._exit(3)
    if k == "hang": time.sleep(60)
    if k == "long": print("x" * 5000, flush=True)
    if k == "junk": print("not json", flush=True)
    print(json.dumps({"said": k, "n": len(k or "")}), flush=True)
"""


def test_helpers(spark):
    ks = ["a", "die", "b", "hang", "c", "long", "d", "junk", "e", None, "é", "x" * 300_000]
    rows = spark.createDataFrame(list(enumerate(ks)), "id int, k string").coalesce(1)
    began = time.monotonic()
    got = {r["id"]: (r["answer"], r["error"]) for r in external.external(rows, ["k"], [sys.executable, "-S", "-c", HELPER], seconds=3.0, most=1000 + 300_100).collect()}
    assert time.monotonic() - began < 60
    assert [got[i][1] for i in (1, 3, 7)] == ["ended", "timeout", "no JSON"]
    for i in (0, 2, 4, 6, 8, 9, 10, 11):
        assert json.loads(got[i][0]) == {"said": ks[i], "n": len(ks[i] or "")} and got[i][1] is None
    short = external.external(rows.where("id in (4, 5, 6)"), ["k"], [sys.executable, "-S", "-c", HELPER], most=100).collect()
    assert {r["id"]: r["error"] for r in short} == {4: None, 5: "too long", 6: None}


def test_helpers_that_never_answer_are_given_up(spark):
    rows = spark.range(50).coalesce(1)
    got = external.external(rows, ["id"], ["/nonexistent/helper"]).collect()
    assert sorted(r["id"] for r in got) == list(range(50)) and all(r["answer"] is None for r in got)
    assert [r["error"] for r in got][: external.STARTS] == ["not started: No such file or directory"] * external.STARTS and {r["error"] for r in got[external.STARTS :]} == {"not started again"}
    dead = external.external(rows, ["id"], [sys.executable, "-S", "-c", "pass"]).collect()
    assert {r["error"] for r in dead} == {"ended", "not started again"}
    assert external.external(rows.limit(0), ["id"], ["/nonexistent/helper"]).count() == 0
