"""Latency distributions that merge: counts in buckets whose bounds grow by a constant factor.

A bucket's middle is at most `error` of a value away from it, so quantiles have that relative error, whatever was merged.
Distributions are rows (keys, bucket, n): partial aggregation sends one row a key and bucket, and coarser
windows or fewer keys are sums of finer ones. Values from a nanosecond to a year of milliseconds take some 2000 buckets at 1 %.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = 0.01
#: The bucket of values that are not above zero, below all others.
ZERO = -(1 << 30)


def base(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("the relative error lies between 0 and 1")
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = ERROR) -> Column:
    """The bucket (base**(b-1), base**b] of a value; ZERO for zero and less; null and NaN have none."""
    seen = F.when(value > 0, F.ceil(F.log(value) / log(base(error))).cast("int")).otherwise(ZERO)
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), seen)


def middle(b: Column, error: float = ERROR) -> Column:
    g = base(error)
    return F.when(b == ZERO, 0.0).otherwise(2 * F.pow(F.lit(g), b.cast("double")) / (g + 1))


def distribution(calls: DataFrame, keys: Sequence[str], value: str, error: float = ERROR, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """(keys, bucket, n and the named sums) of calls; a call without a value counts in the null bucket."""
    return calls.withColumn("bucket", bucket(F.col(value), error)).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in (sums or {}).items()])


def merge(parts: DataFrame, keys: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Distributions over fewer keys; keys can be columns made for it, such as a coarser window."""
    return parts.groupBy(*keys, "bucket").agg(*[F.sum(c).alias(c) for c in ("n", *sums)])


def quantiles(parts: DataFrame, keys: Sequence[str], named: Mapping[str, float], error: float = ERROR, sums: Sequence[str] = ()) -> DataFrame:
    """(keys, n, the sums, a column a quantile): the middle of the bucket that has the value of rank ceil(q * n). n counts all calls; without values quantiles are null."""
    seen = F.struct(F.col("bucket").alias("b"), F.col("n"))
    one = parts.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums], F.array_sort(F.collect_list(F.when(F.col("bucket").isNotNull(), seen))).alias("x"))

    def at(q: float) -> Column:
        rank = F.greatest(F.ceil(q * F.col("whole") - 1e-9), F.lit(1))
        # the sum before each bucket grows along the array; the rank's bucket is the last one before which fewer are
        found = F.aggregate("x", F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("int").alias("b")), lambda a, x: F.struct((a["c"] + x["n"]).alias("c"), F.when(a["c"] < rank, x["b"]).otherwise(a["b"]).alias("b")), lambda a: a["b"])
        return middle(found, error)

    whole = F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return one.withColumn("whole", whole).select(*keys, "n", *sums, *[F.when(F.size("x") > 0, at(q)).alias(name) for name, q in named.items()])
