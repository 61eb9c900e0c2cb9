"""Named read-only query tools, and user functions registered for SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.operators import range as r
from opsframe.operators import vector as v
from opsframe.operators.select import log_query, match, parse_selector
from opsframe.sources.tables import select_source

TOOLS: dict[str, Callable[..., DataFrame]] = {}


def tool(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    TOOLS[f.__name__] = f
    return f


def call(name: str, spark: SparkSession, sf_dir: str, arguments: str = "{}") -> DataFrame:
    """A tool by name with JSON arguments."""
    return TOOLS[name](spark, sf_dir, **json.loads(arguments))


@tool
def query_promql(spark: SparkSession, sf_dir: str, selector: str, at: int, lookback: int = r.LOOKBACK) -> DataFrame:
    """An instant selector."""
    name, matchers = parse_selector(selector)
    d = select_source(spark, sf_dir, "samples").where(match([("name", "=", name), *matchers]))
    return r.instant(d, ["name", "host"], at, lookback).df


@tool
def query_logql(spark: SparkSession, sf_dir: str, query: str, limit: int = 1000) -> DataFrame:
    return select_source(spark, sf_dir, "logs").where(log_query(query)).orderBy(F.desc("t"), F.desc("id")).limit(limit)


@tool
def list_metric_catalog(spark: SparkSession, sf_dir: str, search: str = "") -> DataFrame:
    d = select_source(spark, sf_dir, "samples").where(F.col("name").contains(search))
    return d.groupBy("name").agg(F.count_distinct("host").alias("series"), F.max("t").alias("last")).orderBy("name")


@tool
def rank_hosts(spark: SparkSession, sf_dir: str, metric: str, k: int = 10, largest: bool = True) -> DataFrame:
    d = select_source(spark, sf_dir, "samples").where(F.col("name") == metric).groupBy("host").agg(F.max_by("value", "t").alias("value"))
    return v.Vector.of(d, ["host"]).top(min(k, 50), largest=largest).df


@tool
def find_outlier_hosts(spark: SparkSession, sf_dir: str, metric: str, limit: float = 2.0) -> DataFrame:
    d = select_source(spark, sf_dir, "samples").where(F.col("name") == metric).groupBy("host").agg(F.max_by("value", "t").alias("value"))
    x = v.Vector.of(d, ["host"])
    centred = x.group_left(x.agg("avg"), lambda a, b: a - b)
    z = centred.group_left(x.agg("stddev"), lambda a, b: a / F.nullif(b, F.lit(0.0)))
    return z.where(lambda s: F.abs(s) >= limit).df.withColumnRenamed("value", "score")


@tool
def get_host_summary(spark: SparkSession, sf_dir: str, host: int) -> DataFrame:
    d = select_source(spark, sf_dir, "samples").where(F.col("host") == host)
    return d.groupBy("name").agg(F.max_by("value", "t").alias("value"), F.max("t").alias("t")).orderBy("name")


def register(spark: SparkSession) -> None:
    """Functions for SQL: human_bytes, as an expression that Catalyst inlines."""
    units = " ".join(f"WHEN n >= {1024.0**i:.0f}D THEN concat(format_string('%.1f', n / {1024.0**i:.0f}D), ' {u}')" for i, u in reversed(list(enumerate(("KiB", "MiB", "GiB", "TiB"), 1))))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION human_bytes(n DOUBLE) RETURNS STRING RETURN CASE {units} WHEN n IS NOT NULL THEN concat(format_string('%.0f', n), ' B') END")
