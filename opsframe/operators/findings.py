"""Indicators of databases from a table of checks, and the findings that their thresholds give.

All checks are one pass over the samples: a counter's growth, a gauge's mean or maximum, or the share of
one counter in another. A check whose metrics have no samples gives no row, as missing isn't zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .range import Grid, increase, over_time


@dataclass(frozen=True)
class Check:
    """how: increase, rate, max or avg of metric, or percent of its growth in that of `of` (at least 1)."""

    name: str
    metric: str
    how: str
    of: str | None = None
    critical_above: float | None = None
    critical_below: float | None = None
    warning_above: float | None = None
    warning_below: float | None = None


def severity(value: Column, check: Check) -> Column:
    """The first of the check's limits that the value breaks: critical ones come first."""
    out = F.lit(None).cast("string")
    for name, limit, above in (("warning", check.warning_below, False), ("warning", check.warning_above, True), ("critical", check.critical_below, False), ("critical", check.critical_above, True)):
        if limit is not None:
            out = F.when(value > limit if above else value < limit, name).otherwise(out)
    return out


def findings(samples: DataFrame, keys: Sequence[str], checks: Sequence[Check], at: int, window: int) -> DataFrame:
    """(keys, check, value, severity) from samples (keys, name, t, value), where name is a metric; severity is null for what is well."""
    grid, names = Grid.instant(at, window), {c.metric for c in checks} | {c.of for c in checks if c.of}
    some = samples.where(F.col("name").isin(sorted(names)))
    parts = [increase(some, [*keys, "name"], grid).select(*keys, "name", F.lit("increase").alias("how"), "value")]
    parts += [over_time(h, some, [*keys, "name"], grid).select(*keys, "name", F.lit(h).alias("how"), "value") for h in sorted({c.how for c in checks} & {"max", "avg"})]
    wide = parts[0]
    for p in parts[1:]:
        wide = wide.unionByName(p)

    def of(metric: str, how: str) -> Column:
        return F.max(F.when((F.col("name") == metric) & (F.col("how") == how), F.col("value")))

    def value(c: Check) -> Column:
        if c.how == "rate":
            return of(c.metric, "increase") / (window / 1e6)
        if c.how == "percent":
            return 100 * of(c.metric, "increase") / F.greatest(of(str(c.of), "increase"), F.lit(1.0))
        return of(c.metric, c.how)

    made = wide.groupBy(*keys).agg(*[value(c).alias(c.name) for c in checks])
    rows = F.array(*[F.struct(F.lit(c.name).alias("check"), F.col(c.name).alias("value"), severity(F.col(c.name), c).alias("severity")) for c in checks])
    return made.select(*keys, F.inline(rows)).where("value is not null")
