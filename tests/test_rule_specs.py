"""Line filters, selectors and alert specs: by hand, and chains against a plain loop over characters."""

import random
import re

import pytest
from pyspark.sql import functions as F

from opsframe.operators import log_filters as lf
from opsframe.operators import specs

OPS = ["|=~", "|=", "|~", "!=", "!~"]


def plain_stages(text):
    """(op, body) of a chain, one character after the other; None where it is none."""
    rest, out = (text or "").strip(), []
    while rest:
        op = next((o for o in OPS if rest.startswith(o)), None)
        if not op:
            return None
        rest = rest[len(op):].strip()
        if rest.startswith('"'):
            i, raw = 1, ""
            while i < len(rest) and rest[i] != '"':
                step = 2 if rest[i] == "\\" else 1
                raw, i = raw + rest[i:i + step], i + step
            if i >= len(rest) or not raw:
                return None
            body, odd, j = "", False, 0
            while j < len(raw):
                if raw[j] == "\\":
                    odd |= raw[j + 1] not in '"\\ntr'
                    body, j = body + {"n": "\n", "t": "\t", "r": "\r"}.get(raw[j + 1], raw[j + 1]), j + 2
                else:
                    body, j = body + raw[j], j + 1
            body, rest = raw.strip('"') if odd else body, rest[i + 1:].strip()
        else:
            end = next((i for i in range(1, len(rest)) if rest[i - 1] in " \t" and any(rest.startswith(o, i) for o in OPS)), len(rest))
            body, rest = rest[:end].strip(), rest[end:].strip()
        if not body:
            return None
        out.append(("|~" if op == "|=~" else op, body))
    return out


def test_stages_against_a_loop(spark):
    rng, pieces = random.Random(5), ['|=', '|~', '!=', '!~', '|=~', ' ', ' ', '"', 'a', 'level=error', '\\"', '\\\\', '\\d', '\\n', '.', '|', 'b c', '\t', '=', '""']
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts += ["|= " + '"' + "".join(rng.choice(pieces[8:]).replace('"', "") for _ in range(5)) + '" |~ x' for _ in range(500)] + ["", "  ", '|= "' + "y" * 200_000 + '"', "|~ " + "z" * 200_000]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = lf.strip(F.col("t"))
    got = {r["i"]: r for r in d.select("i", lf.is_chain(t).alias("chain"), lf.stages(F.col("t")).alias("s")).collect()}
    for i, text in enumerate(texts):
        want = plain_stages(text)
        assert got[i]["chain"] == bool(want), text
        if want:
            assert [tuple(s) for s in got[i]["s"]] == want, text
        else:
            assert len(got[i]["s"]) == (1 if text.strip() else 0), text
    assert sum(bool(plain_stages(t)) for t in texts) > 500


@pytest.mark.parametrize("text, pattern, matchers", [
    ('|= "a.b" != "c|d"', r"a\.b|c|d", []),
    ("plain words", "plain words", []),
    ('|= "level=error"', "", [("level", "=", "error")]),
    ("(?i)severity!=debug .*x|y", "x|y", [("level", "!=", "debug")]),
    ('|~ "unit=~nginx" |= oops', "oops", [("unit", "=~", "nginx")]),
    ("level=error", "level=error", []),  # without an operator it is a pattern as it stands
    ('|= "password=x"', "password=x", []),
    ("(pod|unit)[=:]sshd.*failed", "failed", [("unit", "=", "sshd")]),
    ("(pod|node)[=:]sshd.*failed", "(pod|node)[=:]sshd.*failed", []),
    ('|= "open', r'"open', []),
    ("", "", []), (None, "", []),
])
def test_line_filters(spark, text, pattern, matchers):
    x = spark.createDataFrame([(text,)], "t string").select(lf.line_filter(F.col("t")).alias("f")).first()["f"]
    assert (x["pattern"], [tuple(m) for m in x["matchers"]]) == (pattern, matchers)


@pytest.mark.parametrize("text, want", [
    ('{severity="a", level="b", app="c"}', '{level="a"}'), ("", "{x}"), (None, "{x}"), ('{app="c"}', "{x}"), ('{job="journald", unit=~"a\\"b\\\\c"}', '{source=~"journald(:.*)?",unit=~"a\\"b\\\\c"}'),
    ('{job="journal", source="s", priority="1"}', '{source="s"}'), ('{unit="a,b}"}', '{unit="a,b}"}'),
])
def test_selectors(spark, text, want):
    m = lf.stream_matchers(F.col("t"), '{source="fallback"}')
    assert spark.createDataFrame([(text,)], "t string").select(lf.shown(m).alias("s")).first()["s"] == want.replace("{x}", '{source="fallback"}')


def test_literals_match_themselves(spark):
    for r in spark.createDataFrame([(s,) for s in [r"a.b*c", r"\d+[x](y){2}^$|?", "plain"]], "t string").select("t", lf.literal(F.col("t")).alias("p")).collect():
        assert re.fullmatch(r["p"], r["t"])


def run(spark, *rules):
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(rules)], "i int, kind string, spec map<string,string>")
    return [(x["kind"], x["spec"]) for x in specs.normalise(d).orderBy("i").collect()]


def test_rules(spark):
    got = run(
        spark, ("log", {"query": '{unit="u"} |= "x"', "stream_selector": '{unit="own"}'}), ("log", {"query": "no query"}), ("Host-Metric", {"metric": "load", "operator": "odd"}),
        ("", {"metric": "rx", "op": "lt", "value": "nan?"}), (None, {"expr": "up == 1", "op": "gt", "threshold": "3"}), ("latency", {"latency_ms": "x", "value": "9"}),
        ("forecast", {"expr": "node_filesystem_free_bytes/node_filesystem_size_bytes", "threshold": "120"}), ("", {"keywords": "k", "sli": "s"}), ("mine", {"a": "b"}),
        ("", {"stream_selector": "{}", "ratio_op": "lt"}), ("metric_anomaly", {"metric": "Memory-Usage"}),
    )
    assert got[0][1]["stream_selector"] == '{unit="own"}' and got[0][1]["line_filter"] == "x" and "query" not in got[0][1]
    assert got[1][1]["query"] == "no query" and got[1][1]["stream_selector"] == lf.JOURNAL and "line_filter" not in got[1][1]
    assert got[2] == ("metric_threshold", {"metric": "load", "operator": ">", "window": "5m", "aggregator": "avg"})
    assert got[3] == ("metric_raw", {"metric": "rx", "op": "lt", "value": "nan?"}) and got[4][1]["expr"] == "up == 1"
    assert got[5][1]["threshold_ms"] == "9" and got[6][1]["threshold"] == "120" and "expr" in got[6][1]
    assert got[7][0] == "log_search" and got[8] == ("mine", {"a": "b"})
    assert got[9][0] == "log_volume" and got[9][1]["stream_selector"] == lf.EVERYTHING and got[9][1]["ratio_op"] == "<"
    assert got[10][1]["metric"] == "mem_pct"
    assert run(spark) == []
