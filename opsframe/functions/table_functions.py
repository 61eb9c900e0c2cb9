"""Tools as table functions of SQL.

Those over fixed views are SQL themselves, so that Catalyst plans what they stand for; instant_selector takes any table of
samples: its result's columns follow from that table, and it says itself how the table is to be partitioned and sorted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import DoubleType, StructField, StructType

from opsframe.operators.range import LOOKBACK
from opsframe.operators.select import parse_selector

#: Over the views samples (name, host, t, value) and logs (id, t, service, host, severity_text, message).
SQL = {
    "metric_catalog(search STRING)": ("name STRING, series BIGINT, last BIGINT", "SELECT name, count(DISTINCT host), max(t) FROM samples WHERE contains(name, metric_catalog.search) GROUP BY name"),
    "ranked_hosts(metric STRING, k INT)": ("place INT, host BIGINT, value DOUBLE", """SELECT place, host, value FROM (SELECT row_number() OVER (ORDER BY value DESC, host) AS place, host, value
 FROM (SELECT host, max_by(value, t) AS value FROM samples WHERE name = ranked_hosts.metric GROUP BY host)) WHERE place <= least(ranked_hosts.k, 50)"""),
    "host_summary(host_id BIGINT)": ("name STRING, value DOUBLE, t BIGINT", "SELECT name, max_by(value, t), max(t) FROM samples WHERE host = host_summary.host_id GROUP BY name"),
    "log_counts(word STRING, bucket BIGINT)": ("start BIGINT, level STRING, n BIGINT", "SELECT t div log_counts.bucket * log_counts.bucket, severity_text, count(*) FROM logs WHERE contains(lower(message), lower(log_counts.word)) GROUP BY ALL"),
}


@dataclass
class _Plan(AnalyzeResult):
    matchers: list = field(default_factory=list)
    keys: list = field(default_factory=list)


@udtf
class InstantSelector:
    """instant_selector(TABLE(samples), selector, at [, lookback]): the newest sample of each series, at most `lookback` microseconds old.

    The table has t (microseconds), value, and columns that tell series apart, among them `name`, the metric. Nulls match as
    empty labels; a null value is no sample.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, selector: AnalyzeArgument, at: AnalyzeArgument, lookback: AnalyzeArgument | None = None) -> _Plan:
        if not rows.isTable:
            raise ValueError("the first argument is a table: TABLE(samples)")
        names = [f.name for f in rows.dataType]
        if missing := {"t", "value", "name"} - set(names):
            raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
        for a in (selector, at):
            if not a.isConstantExpression or a.value is None:
                raise ValueError("selector and time are constants")
        text = selector.value.strip()
        name, matchers = parse_selector(text) if not text.startswith("{") else ("", parse_selector("any" + text)[1])
        if unknown := {m[0] for m in matchers} - set(names):
            raise ValueError(f"no label {', '.join(sorted(unknown))}")
        keys = [n for n in names if n not in ("t", "value")]
        schema = StructType([*[f for f in rows.dataType if f.name in keys], StructField("value", DoubleType())])
        own = [("name", "=", name)] if name else []
        return _Plan(schema=schema, partitionBy=[PartitioningColumn(k) for k in keys], orderBy=[OrderingColumn("t")], matchers=[tuple(m) for m in (*own, *matchers)], keys=keys)

    def __init__(self, plan: _Plan):
        self.plan, self.wanted, self.found = plan, None, None

    def eval(self, rows: Row, selector: str, at: int, lookback: int | None = None):
        if self.wanted is None:  # all rows of a partition are one series
            self.wanted = all(_matches(rows[label], op, value) for label, op, value in self.plan.matchers)
        if self.wanted and rows["value"] is not None and at - (LOOKBACK if lookback is None else lookback) <= rows["t"] <= at:
            self.found = (*[rows[k] for k in self.plan.keys], float(rows["value"]))

    def terminate(self):
        if self.found is not None:
            yield self.found


def _matches(label, op: str, value: str) -> bool:
    text = "" if label is None else str(label)
    hit = re.fullmatch(value, text) is not None if op.endswith("~") else text == value
    return hit != op.startswith("!")


def register(spark: SparkSession, samples: DataFrame, logs: DataFrame) -> None:
    """The views samples and logs, and the functions."""
    samples.createOrReplaceTempView("samples")
    logs.createOrReplaceTempView("logs")
    for head, (columns, body) in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE ({columns}) RETURN {body}")
    spark.udtf.register("instant_selector", InstantSelector)
