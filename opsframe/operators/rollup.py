"""Down-sampling tiers, their retention and choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000

#: Tier, bucket and how long it is kept.
TIERS = {"raw": (0, 7 * DAY), "5m": (5 * MINUTE, 90 * DAY), "1h": (HOUR, 365 * DAY)}


def bucket(t: str, size: int):
    """The start of the epoch-aligned bucket."""
    return (F.floor(F.col(t) / F.lit(size)) * size).cast("long")


def to_five_minutes(points: DataFrame, keys: Sequence[str], gauges: Sequence[str], counters: Sequence[str], t: str = "t", size: int = 5 * MINUTE) -> DataFrame:
    """Mean and maximum of gauges, sums of counters."""
    aggs = [x for g in gauges for x in (F.avg(g).alias(f"{g}_avg"), F.max(g).alias(f"{g}_max"))] + [F.sum(c).alias(f"{c}_sum") for c in counters]
    return points.groupBy(*keys, bucket(t, size).alias("ts")).agg(*aggs)


def to_hours(five: DataFrame, keys: Sequence[str], gauges: Sequence[str], counters: Sequence[str], weights: str | None = None) -> DataFrame:
    """Hours from five-minute rows. The mean is that of means, unweighted, as the original computes it; `weights` names a column of counts for a weighted one."""
    mean = lambda g: F.avg(f"{g}_avg") if weights is None else F.sum(F.col(f"{g}_avg") * F.col(weights)) / F.sum(weights)
    aggs = [x for g in gauges for x in (mean(g).alias(f"{g}_avg"), F.max(f"{g}_max").alias(f"{g}_max"))] + [F.sum(f"{c}_sum").alias(f"{c}_sum") for c in counters]
    return five.groupBy(*keys, bucket("ts", HOUR).alias("hour")).agg(*aggs).withColumnRenamed("hour", "ts")


def retain(rows: DataFrame, tier: str, now: int, t: str = "t") -> DataFrame:
    return rows.where(F.col(t) >= now - TIERS[tier][1])


def choose_tier(span: int) -> str:
    """Raw up to six hours, five minutes up to seven days, hours beyond."""
    return "raw" if span <= 6 * HOUR else "5m" if span <= 7 * DAY else "1h"
