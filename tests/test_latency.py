"""Mergeable latency distributions: their error, merging, and odd values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from opsframe.operators import latency

Q = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def frame(spark, rows):
    return spark.createDataFrame(rows, "service string, window int, ms double")


@pytest.mark.parametrize("error", [0.01, 0.05])
def test_relative_error_and_merging(spark, error):
    rng = random.Random(4)
    rows = [(f"s{i % 4}", i % 7, 10 ** rng.uniform(-6, 9)) for i in range(4000)]
    parts = latency.distribution(frame(spark, rows), ["service", "window"], "ms", error)
    merged = latency.quantiles(latency.merge(parts, ["service"]), ["service"], Q, error).collect()
    direct = latency.quantiles(latency.distribution(frame(spark, rows), ["service"], "ms", error), ["service"], Q, error).collect()
    assert sorted(merged) == sorted(direct) and len(merged) == 4
    for r in merged:
        own = sorted(ms for s, _, ms in rows if s == r["service"])
        assert r["n"] == len(own)
        for name, q in Q.items():
            exact = own[max(1, math.ceil(q * len(own) - 1e-9)) - 1]
            assert abs(r[name] - exact) <= error * exact * (1 + 1e-9)


def test_odd_values(spark):
    rows = [("a", 0, 0.0), ("a", 0, -3.0), ("a", 0, 5.0), ("a", 0, None), ("a", 0, math.nan), ("none", 0, None), ("zero", 0, 0.0)]
    got = {r["service"]: r for r in latency.quantiles(latency.distribution(frame(spark, rows), ["service"], "ms", sums={"bad": F.lit(1)}), ["service"], Q, sums=["bad"]).collect()}
    assert got["a"]["n"] == 5 and got["a"]["bad"] == 5 and got["a"]["p50"] == 0.0 and got["a"]["p100"] == pytest.approx(5.0, rel=0.01)
    assert got["none"]["p50"] is None and got["none"]["n"] == 1 and got["zero"]["p99"] == 0.0
    assert latency.quantiles(latency.distribution(frame(spark, []), ["service"], "ms"), ["service"], Q).count() == 0
    with pytest.raises(ValueError):
        latency.base(1.0)


def test_only_buckets_are_shuffled(spark):
    rows = spark.range(100_000).select(F.lit("s").alias("service"), (F.col("id") % 1000 + 1).cast("double").alias("ms"))
    parts = latency.distribution(rows, ["service"], "ms")
    assert parts.count() < 1 + math.log(1000) / math.log(latency.base(0.01)) + 1
