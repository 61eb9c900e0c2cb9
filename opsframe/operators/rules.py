"""Alert rules over vectors, and the incidents that firings make."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .range import SECOND, Grid, over_time, predict_linear
from .select import compare
from .vector import Vector


def threshold(conditions: Sequence[tuple[Vector, str, float]], every: bool, on: Sequence[str]) -> Vector:
    """Conditions on vectors: all of them, or any; the first one's labels and values stay."""
    parts = [v.where(lambda x, o=op, k=value: compare(x, o, k)) for v, op, value in conditions]
    return reduce(lambda a, b: a.and_(b, on) if every else a.or_(b, on), parts)


def anomaly(samples: DataFrame, keys: Sequence[str], at: int, window: int, step: int, limit: float, method: str = "zscore") -> DataFrame:
    """(keys, value, score) of series away from their baseline over a grid of steps; no spread gives no row.

    zscore: |value - mean| / population deviation. mad: |value - median| / mean absolute deviation from the median.
    """
    grid = Grid(at - window + step, at, step, step)
    points = over_time("last", samples, keys, grid)
    w = Window.partitionBy(*keys)
    now = points.withColumn("now", F.max_by("value", "at").over(w))
    if method == "zscore":
        out = now.groupBy(*keys).agg(F.first("now").alias("value"), F.avg("value").alias("c"), F.stddev_pop("value").alias("d"))
    else:
        mid = now.groupBy(*keys).agg(F.percentile("value", 0.5).alias("c"))
        out = now.join(mid, list(keys)).groupBy(*keys).agg(F.first("now").alias("value"), F.first("c").alias("c"), F.avg(F.abs(F.col("value") - F.col("c"))).alias("d"))
    return out.where("d > 0").withColumn("score", F.abs(F.col("value") - F.col("c")) / F.col("d")).where(F.col("score") >= limit).select(*keys, "value", "score")


def forecast(samples: DataFrame, keys: Sequence[str], at: int, window: int, ahead_s: float, op: str, limit: float) -> DataFrame:
    v = predict_linear(samples, keys, Grid.instant(at, window), ahead_s)
    return v.where(compare("value", op, limit)).drop("at")


def burn_rate(requests: DataFrame, keys: Sequence[str], at: int, windows: Sequence[tuple[int, float]], slo: float, t: str = "t") -> DataFrame:
    """(keys, value) where the error ratio of every window is at least its multiple of the budget; value is the largest ratio.

    One pass: a conditional count for each window. A window without requests doesn't fire.
    """
    inside = lambda w: (F.col(t) > at - w) & (F.col(t) <= at)
    aggs = [x for i, (w, _) in enumerate(windows) for x in (F.count_if(inside(w)).alias(f"n{i}"), F.count_if(inside(w) & F.col("error")).alias(f"e{i}"))]
    ratios = [F.col(f"e{i}") / F.nullif(F.col(f"n{i}"), F.lit(0)) for i in range(len(windows))]
    fired = reduce(lambda a, b: a & b, [F.coalesce(r >= m * (1 - slo / 100), F.lit(False)) for r, (_, m) in zip(ratios, windows, strict=True)])
    longest = max(w for w, _ in windows)
    return requests.where(inside(longest)).groupBy(*keys).agg(*aggs).where(fired).select(*keys, F.greatest(*ratios, F.lit(0.0)).alias("value"))


def contiguous(evaluations: DataFrame, keys: Sequence[str], condition: Column, minimum: int, t: str = "t") -> DataFrame:
    """(keys, since, until): runs in which the condition held at every evaluation, at least `minimum` long; gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(t)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "__c").orderBy(t))
    runs = evaluations.withColumn("__c", condition).withColumn("__i", island).where("__c")
    return runs.groupBy(*keys, "__i").agg(F.min(t).alias("since"), F.max(t).alias("until")).where(F.col("until") - F.col("since") >= minimum).drop("__i")


def preview(fired: DataFrame, t: str = "t", last: int = 5) -> DataFrame:
    """How often a rule would have fired, when first and last, and the last few values, newest first."""
    tail = F.transform(F.slice(F.sort_array(F.collect_list(F.struct(t, "value")), asc=False), 1, last), lambda x: x["value"])
    # a list of all firings isn't needed for the last few: they are picked first
    newest = fired.orderBy(F.desc(t), F.desc("value")).limit(last).agg(tail.alias("samples"))
    return fired.agg(F.count(F.lit(1)).alias("fires"), F.min(t).alias("first"), F.max(t).alias("last")).crossJoin(newest)


def representative(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The series with most points, then the highest mean, then the smallest key."""
    return points.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean")).orderBy(F.desc("n"), F.desc("mean"), *keys).limit(1)


def thin(points: DataFrame, keys: Sequence[str], most: int, t: str = "t") -> DataFrame:
    """About `most` points of each series: every stride-th from the first, and the last."""
    w = Window.partitionBy(*keys)
    n = points.withColumn("__k", F.row_number().over(w.orderBy(t)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    stride = F.greatest(F.lit(1), F.ceil(F.col("__n") / F.lit(most)))
    return n.where((F.pmod("__k", stride) == 0) | (F.col("__k") == F.col("__n") - 1)).drop("__k", "__n")


def dedupe_key(labels: Column, without: Sequence[str] = ("__name__", "instance", "job")) -> Column:
    """Sorted k=v pairs of the labels that identify; parts are length-prefixed."""
    kept = F.map_filter(labels, lambda k, v: ~k.isin(list(without)))
    part = lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)
    return F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(part(e["key"]), F.lit("="), part(e["value"]))), ",")


def recovered(before: DataFrame, now: DataFrame, keys: Sequence[str]) -> DataFrame:
    return before.join(now.select(*keys), list(keys), "left_anti")


def incidents(firings: DataFrame, keys: Sequence[str], tick: int, t: str = "t") -> DataFrame:
    """(keys, incident, opened, last_fired, resolved, fires): a firing that isn't on the tick after the last one opens a new incident.

    resolved is the tick after the last firing, null if the stream ends there.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    new = F.when(F.col(t) - F.lag(t).over(w) <= tick, 0).otherwise(1)
    numbered = firings.withColumn("__new", new).withColumn("incident", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*keys, "incident").agg(F.min(t).alias("opened"), F.max(t).alias("last_fired"), F.count(F.lit(1)).alias("fires"))
    end = firings.agg(F.max(t).alias("__end"))
    return out.crossJoin(F.broadcast(end)).withColumn("resolved", F.when(F.col("last_fired") < F.col("__end"), F.col("last_fired") + tick)).drop("__end")


def notifications(firings: DataFrame, keys: Sequence[str], silenced: Column, cooldown: int, window: int, minimum: int, inhibited: Column, t: str = "t") -> DataFrame:
    """firings with `outcome`, the first that applies: silenced, cooldown, dampened, inhibited, else notified.

    Dampening wants `minimum` firings in the window. Cooldown runs from the last firing that got through
    everything else, so it is a fold over a key's firings in order: they are read as a sorted stream, and
    one time a key is held.
    """
    ready = firings.withColumns({"__s": silenced, "__i": inhibited}).repartition(*keys).sortWithinPartitions(*keys, t)
    recent = F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(t).rangeBetween(-window, 0))
    rows = ready.withColumn("__d", recent < minimum).select(*keys, F.col(t).alias("t"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("__s", "__d", "__i")])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        last: int | None = None
        for b in batches:
            out = []
            own = [tuple(None if pd.isna(x) else x for x in k) for k in zip(*(b[k].tolist() for k in keys), strict=True)]
            for key, at, hushed, damp, below in zip(own, *(b[c].tolist() for c in ("t", "__s", "__d", "__i")), strict=True):
                if key != now:
                    now, last = key, None
                cooling = last is not None and at - last < cooldown
                out.append("silenced" if hushed else "cooldown" if cooling else "dampened" if damp else "inhibited" if below else "notified")
                last = at if out[-1] == "notified" else last
            yield b[[*keys, "t"]].assign(outcome=out)

    types = dict(firings.dtypes)
    return rows.mapInPandas(fold, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", t long, outcome string")


def retry_due(deliveries: DataFrame, now: int, most: int = 5) -> DataFrame:
    """Failed deliveries whose linear back-off, a minute for each attempt, has passed."""
    return deliveries.where((F.col("attempts") < most) & (F.col("finished") + F.col("attempts") * 60 * SECOND <= now))
