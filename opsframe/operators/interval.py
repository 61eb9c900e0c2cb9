"""Joins on time: intervals, as-of, and matches with wildcards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, lo: str, hi: str, t: str, width: int, on: Sequence[str] = ()) -> DataFrame:
    """Rows of left and right with lo <= t <= hi, and equal `on` columns, null-safely.

    Time is cut into buckets of `width`, so that the join is on equality: an interval goes to each bucket
    it touches (two, if width is the usual length), a point to its own. Right's `on` columns are dropped.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    a = left.withColumn("__b", F.explode(F.sequence(bucket(lo), bucket(hi))))
    b = right.withColumn("__c", bucket(t))
    cond: Column = F.col("__b") == F.col("__c")
    for k in on:
        b = b.withColumnRenamed(k, f"__{k}")
        cond = cond & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(b, cond & F.col(t).between(F.col(lo), F.col(hi))).drop("__b", "__c", *[f"__{k}" for k in on])


def interval_counts(left: DataFrame, right: DataFrame, keys: Sequence[str], lo: str, hi: str, t: str, by: Sequence[str], width: int) -> DataFrame:
    """(keys, by, n): how many pairs with lo <= t <= hi the rows of left and right make, without making them; groups without any are left out.

    In each bucket of `width` that an interval touches, the count of right's rows up to its end there less those before its start,
    from one sort of the bucket's rows and ends by group: time and rows grow with the rows, not the pairs. lo, hi and t are whole
    numbers; null keys and groups are values as others. An interval has an end a bucket and group, so width is several usual lengths.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    keys, by = list(keys), list(by)
    own, groups = [f"__k{i}" for i in range(len(keys))], [f"__g{i}" for i in range(len(by))]
    rows = right.where(F.col(t).isNotNull()).groupBy(bucket(t).alias("__b"), F.col(t).alias("__x"), *[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)]).agg(F.count(F.lit(1)).alias("__c"))
    kinds = right.where(F.col(t).isNotNull()).select(bucket(t).alias("__b"), *[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)]).distinct()
    spans = left.where(F.col(lo) <= F.col(hi)).select(*[F.col(c).alias(k) for c, k in zip(keys, own, strict=True)], F.col(lo).alias("__lo"), F.col(hi).alias("__hi"), F.explode(F.sequence(bucket(lo), bucket(hi))).alias("__b"))
    end = lambda x, sign: F.struct(x.cast("long").alias("x"), F.lit(sign).alias("sign"))
    upper = end(F.least(F.col("__hi"), (F.col("__b") + 1) * width - 1), 1)
    ends = F.when(F.col("__lo") > F.col("__b") * width, F.array(upper, end(F.col("__lo") - 1, -1))).otherwise(F.array(upper))
    asked = spans.select(*own, "__b", F.explode(ends).alias("__e")).join(kinds, "__b")
    one = rows.select("__b", *groups, "__x", F.lit(0).alias("__sign"), "__c", *[F.lit(None).cast(left.schema[c].dataType).alias(k) for c, k in zip(keys, own, strict=True)])
    two = asked.select("__b", *groups, F.col("__e.x").alias("__x"), F.col("__e.sign").alias("__sign"), F.lit(0).cast("long").alias("__c"), *own)
    # at equal times the rows come before the ends
    before = Window.partitionBy("__b", *groups).orderBy("__x", F.col("__sign") != 0).rowsBetween(Window.unboundedPreceding, 0)
    counted = one.unionByName(two).withColumn("__n", F.sum("__c").over(before)).where("__sign <> 0")
    out = counted.groupBy(*own, *groups).agg(F.sum(F.col("__sign") * F.col("__n")).alias("n")).where("n > 0")
    return out.select(*[F.col(k).alias(c) for c, k in zip(keys, own, strict=True)], *[F.col(g).alias(c) for c, g in zip(by, groups, strict=True)], "n")


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], t: str, take: Sequence[str], within: int | None = None) -> DataFrame:
    """left with the columns `take` of right's last row at or before t, null if none lies within `within`.

    Both sides are united and sorted once by (on, t); right's rows come first at equal times. No row of
    right is paired with more than the rows that take it, whatever the skew of either side.
    """
    extra = [c for c in left.columns if c not in (*on, t)]
    a = left.select(*on, t, F.lit(1).alias("__side"), F.struct(*extra).alias("__row"), F.lit(None).cast("long").alias("__rt"), *[F.lit(None).alias(f"__{c}") for c in take])
    b = right.select(*on, t, F.lit(0).alias("__side"), F.lit(None).alias("__row"), F.col(t).alias("__rt"), *[F.col(c).alias(f"__{c}") for c in take])
    both = b.unionByName(a)
    w = Window.partitionBy(*on).orderBy(t, "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("__side") == 0, F.struct("__rt", *[f"__{c}" for c in take])), ignorenulls=True).over(w)
    out = both.withColumn("__seen", seen).where("__side = 1")
    fresh = F.lit(True) if within is None else F.col("__seen.__rt") >= F.col(t) - within
    return out.select(*on, t, "__row.*", *[F.when(fresh, F.col(f"__seen.__{c}")).alias(c) for c in take])


def wildcard_match(rows: DataFrame, rules: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """rows with each rule whose columns, {rule's column: row's column}, equal the row's or are null.

    Rules are split by which of their columns are null: each kind is an equi-join, so there is no nested
    loop. Kinds are at most 2 ** len(columns).
    """
    names = list(columns)
    out = None
    for kind in range(2 ** len(names)):
        used = [n for i, n in enumerate(names) if kind >> i & 1]
        some = rules
        for n in names:
            some = some.where(F.col(n).isNotNull() if n in used else F.col(n).isNull())
        some = some.select(*[F.col(n).alias(f"__{n}") if n in names else F.col(n) for n in rules.columns])
        cond = F.lit(True)
        for n in used:
            cond = cond & (F.col(f"__{n}") == F.col(columns[n]))
        part = rows.join(some, cond).drop(*[f"__{n}" for n in names])
        out = part if out is None else out.unionByName(part)
    return out
