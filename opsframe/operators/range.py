"""Range-vector functions: windows of samples of a series at each step of a grid.

A sample is dealt to the evaluation times whose window holds it, so a range query is one projection
and one aggregation by (series, time): no join of samples with a grid, and partial aggregation before
its only shuffle. Functions that look at neighbouring samples take them from one lag over the series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vector import Vector

SECOND = 1_000_000
LOOKBACK = 300 * SECOND


@dataclass(frozen=True)
class Grid:
    """Evaluation times start, start + step, ... up to end and the window before each, in microseconds.

    left_closed takes a sample at t - window as well.
    """

    start: int
    end: int
    step: int
    window: int
    left_closed: bool = True

    @classmethod
    def instant(cls, at: int, window: int, left_closed: bool = True) -> Grid:
        return cls(at, at, max(window, 1), window, left_closed)

    def spread(self, samples: DataFrame, t: str = "t") -> DataFrame:
        """samples with a row for each `at` whose window holds them."""
        t_ = F.col(t)
        last = t_ + self.window - (0 if self.left_closed else 1)
        held = samples.where((t_ <= self.end) & (last >= self.start))
        if self.start == self.end:
            return held.withColumn("at", F.lit(self.start))
        first = F.greatest(F.lit(0), F.ceil((t_ - self.start) / F.lit(self.step)).cast("long"))
        final = F.least(F.floor((last - self.start) / F.lit(self.step)).cast("long"), F.lit((self.end - self.start) // self.step))
        held = held.withColumn("__f", first).withColumn("__l", final).where("__f <= __l")
        return held.withColumn("at", F.explode(F.transform(F.sequence("__f", "__l"), lambda k: k * self.step + self.start))).drop("__f", "__l")


def _before(samples: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(t)
    return samples.withColumn("__pv", F.lag("value").over(w)).withColumn("__pt", F.lag(t).over(w))


def _inside(grid: Grid) -> Column:
    """Whether the previous sample lies in the window too."""
    edge = F.col("at") - grid.window
    return F.col("__pt") >= edge if grid.left_closed else F.col("__pt") > edge


def _extrapolated(grid: Grid, per_second: bool) -> Column:
    """The extrapolated increase of a counter, from first and last sample, resets and count."""
    span = (F.col("tl") - F.col("tf")) / SECOND
    delta = F.col("vl") - F.col("vf") + F.col("resets")
    average = span / (F.col("n") - 1)
    window = F.lit(grid.window / SECOND)
    left, right = (F.col("tf") - (F.col("at") - grid.window)) / SECOND, (F.col("at") - F.col("tl")) / SECOND
    # a counter can't have been below zero: the line's way down to it bounds the left gap
    zero = F.when((delta > 0) & (F.col("vf") >= 0), span * F.col("vf") / delta)
    side = lambda gap: F.when(gap < 1.1 * average, gap).otherwise(average / 2)
    left = F.least(side(left), F.coalesce(zero, side(left)))
    value = delta * (span + left + side(right)) / span
    return F.when((F.col("n") >= 2) & (span > 0), value / window if per_second else value)


def increase(samples: DataFrame, keys: Sequence[str], grid: Grid, per_second: bool = False, t: str = "t") -> DataFrame:
    """(keys, at, value): the increase of counters, or their rate; a drop is a reset and the value before it is added. Fewer than two samples give no row."""
    some = grid.spread(_before(samples, keys, t), t)
    made = some.groupBy(*keys, "at").agg(
        F.min(t).alias("tf"), F.max(t).alias("tl"), F.min_by("value", t).alias("vf"), F.max_by("value", t).alias("vl"), F.count("value").alias("n"),
        F.sum(F.when(_inside(grid) & (F.col("value") < F.col("__pv")), F.col("__pv")).otherwise(0.0)).alias("resets"),
    )
    return made.select(*keys, "at", _extrapolated(grid, per_second).alias("value")).where("value is not null")


def rate(samples: DataFrame, keys: Sequence[str], grid: Grid, t: str = "t") -> DataFrame:
    return increase(samples, keys, grid, True, t)


def changes(samples: DataFrame, keys: Sequence[str], grid: Grid, t: str = "t") -> DataFrame:
    some = grid.spread(_before(samples, keys, t), t)
    return some.groupBy(*keys, "at").agg(F.sum(F.when(_inside(grid) & (F.col("value") != F.col("__pv")), 1).otherwise(0)).cast("double").alias("value"))


def over_time(how: str, samples: DataFrame, keys: Sequence[str], grid: Grid, q: float = 0.5, t: str = "t") -> DataFrame:
    """count, sum, avg, min, max, stddev (population), quantile (exact, linear), last or present over each window."""
    v = F.col("value")
    agg = {
        "count": lambda: F.count(v), "sum": lambda: F.sum(v), "avg": lambda: F.avg(v), "min": lambda: F.min(v), "max": lambda: F.max(v), "stddev": lambda: F.stddev_pop(v),
        "quantile": lambda: F.percentile(v, q), "last": lambda: F.max_by(v, t), "present": lambda: F.lit(1.0), "timestamp": lambda: F.max(F.col(t)) / SECOND,
    }[how]
    return grid.spread(samples, t).groupBy(*keys, "at").agg(agg().cast("double").alias("value"))


def predict_linear(samples: DataFrame, keys: Sequence[str], grid: Grid, ahead: float, t: str = "t") -> DataFrame:
    """Least squares over the window, with time counted from the evaluation time, `ahead` seconds after it. A single time gives no row."""
    x = (F.col(t) - F.col("at")) / SECOND
    made = grid.spread(samples, t).groupBy(*keys, "at").agg(F.regr_slope("value", x).alias("s"), F.regr_intercept("value", x).alias("i"))
    return made.where("s is not null").select(*keys, "at", (F.col("i") + F.col("s") * ahead).alias("value"))


def subquery(samples: DataFrame, keys: Sequence[str], start: int, end: int, step: int, lookback: int = LOOKBACK, t: str = "t") -> DataFrame:
    """An instant selector on the grid of multiples of step in (start, end]: (keys, t, value), to be used as samples again."""
    first = -(-start // step) * step
    grid = Grid(first, end // step * step, step, lookback)
    made = over_time("last", samples, keys, grid, t=t)
    return made.select(*keys, F.col("at").alias("t"), "value")


def instant(samples: DataFrame, keys: Sequence[str], at: int, lookback: int = LOOKBACK, offset: int = 0, t: str = "t") -> Vector:
    """The newest sample of each series, at most `lookback` old, at `at` less an offset."""
    made = over_time("last", samples, keys, Grid.instant(at - offset, lookback), t=t)
    return Vector.of(made, keys)


def delta_clamped(samples: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """Per-second change between neighbouring samples; a drop counts as 0, unlike a rate's reset."""
    d = _before(samples, keys, t).where("__pt is not null")
    return d.where(F.col(t) > F.col("__pt")).select(*keys, t, (F.greatest(F.col("value") - F.col("__pv"), F.lit(0.0)) / ((F.col(t) - F.col("__pt")) / SECOND)).alias("value"))


def histogram_quantile(q: float, buckets: DataFrame, keys: Sequence[str], le: str = "le") -> DataFrame:
    """(keys, value) from cumulative buckets (keys, le, value): linear inside a bucket, the first one from 0.

    The last finite bound stands for +Inf. Series without a +Inf bucket, with fewer than two buckets or no count give no row.
    """
    w = Window.partitionBy(*keys).orderBy("__le")
    b = buckets.withColumn("__le", F.when(F.col(le).cast("string").isin("+Inf", "Infinity"), float("inf")).otherwise(F.col(le).try_cast("double")))
    all_of = Window.partitionBy(*keys)
    # a bucket that seems lower than one before it is as high: scrapes aren't atomic
    b = b.withColumn("__c", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.select(
        *keys, "__le", "__c", F.lag("__le", 1).over(w).alias("__l0"), F.coalesce(F.lag("__c", 1).over(w), F.lit(0.0)).alias("__c0"),
        F.max("__c").over(all_of).alias("__n"), F.max("__le").over(all_of).alias("__top"),
    )
    rank = q * F.col("__n")
    hit = b.where((F.col("__top") == float("inf")) & (F.col("__n") > 0) & (F.col("__c") >= rank - 1e-9))
    first = hit.groupBy(*keys).agg(F.min_by(F.struct("__le", "__c", "__l0", "__c0", "__n"), "__le").alias("x"))
    x = lambda n: F.col(f"x.{n}")
    low = F.coalesce(x("__l0"), F.when(x("__le") > 0, F.lit(0.0)).otherwise(x("__le")))
    inside = low + (x("__le") - low) * F.when(x("__c") > x("__c0"), (q * x("__n") - x("__c0")) / (x("__c") - x("__c0"))).otherwise(F.lit(0.0))
    return first.select(*keys, F.when(x("__le") == float("inf"), x("__l0")).otherwise(inside).alias("value")).where("value is not null")


def range_step(span_s: float, points: int = 240, least: float = 30.0) -> tuple[float, float]:
    """(step, window) in seconds: at most `points` steps, windows of at least five minutes and four steps."""
    step = max(least, -(-span_s // points))
    return step, max(300.0, 4 * step)
