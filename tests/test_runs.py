"""Span trees to runs by pointer doubling, against a walk over each trace."""

import random

import pytest
from pyspark.sql import functions as F

from opsframe.operators import runs

SCHEMA = "trace_id string, span_id string, parent_span_id string, sdk string, identity string"


def walk(rows):
    """(trace, span) to (run, issue), one span after the other."""
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[0], {})[r[1]] = r
    for trace, spans in by.items():
        parent = {s: r[2] or None for s, r in spans.items()}
        issue = {s: "missing_parent" if p and p not in spans else None for s, p in parent.items()}
        parent = {s: p if p in spans else None for s, p in parent.items()}
        for s in spans:
            seen, x = [], s
            while x is not None and x not in seen:
                seen.append(x)
                x = parent[x]
            if x is not None:
                cut = min(seen[seen.index(x):])
                parent[cut], issue[cut] = None, "cycle"
        for s, r in spans.items():
            run, x = s, parent[s]
            while x is not None:
                if spans[x][3:] == r[3:]:
                    run = x
                x = parent[x]
            out[trace, s] = (run, issue[s])
    return out


def got(spark, rows):
    return {(r["trace_id"], r["span_id"]): (r["run_id"], r["issue"]) for r in runs.assign_runs(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests(spark, seed):
    rng = random.Random(seed)
    rows = []
    for t in [None, *map(str, range(12))]:
        n = rng.randint(1, 60)
        for i in range(n):
            kind = rng.random()
            parent = None if kind < 0.1 else "" if kind < 0.15 else f"{rng.randrange(2 * n):03d}" if kind < 0.3 else f"{rng.randrange(max(1, i)):03d}"
            rows.append((t, f"{i:03d}", parent, rng.choice(["a", "b", None]), rng.choice(["x", "y"])))
    assert got(spark, rows) == walk(rows)


def test_cycles_and_their_tails(spark):
    rows = [("t", "c", "a", "s", "i"), ("t", "a", "b", "s", "i"), ("t", "b", "c", "s", "i"), ("t", "z", "b", "s", "i"), ("t", "0", "z", "other", "i"), ("t", "self", "self", "s", "i"), ("u", "a", None, "s", "i")]
    assert got(spark, rows) == walk(rows)
    assert got(spark, rows)["t", "a"] == ("a", "cycle") and got(spark, rows)["t", "0"] == ("0", None)


def test_odd_rows(spark):
    rows = [("t", "a", None, "s", "i"), ("t", "b", "a", "s", "i"), ("t", "b", "a", "s", "i"), ("t", None, "a", "s", "i"), (None, "b", "a", "s", "i")]
    out = sorted(((r["trace_id"], r["span_id"], r["run_id"], r["issue"]) for r in runs.assign_runs(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert out == sorted([("t", "a", "a", None), ("t", "b", "a", None), ("t", "b", "a", None), ("t", None, None, None), (None, "b", "b", "missing_parent")], key=str)
    assert runs.assign_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_chain(spark):
    n = 60_000
    d = spark.range(n).select(F.lit("t").alias("trace_id"), F.format_string("%07d", "id").alias("span_id"), F.when(F.col("id") > 0, F.format_string("%07d", F.col("id") - 1)).alias("parent_span_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("sdk"), F.lit("i").alias("identity"))
    out = runs.assign_runs(d).groupBy("sdk", "run_id", "issue").count().collect()
    assert sorted(tuple(r) for r in out) == [("a", "0000000", None, n // 3), ("b", "0000001", None, n - n // 3)]
