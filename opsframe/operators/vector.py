"""Instant vectors: key columns and a value, and the algebra on them.

All binary operations are joins on key columns, so Catalyst picks their strategy: after an aggregation
on the keys no further shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "stddev": F.stddev_pop, "stdvar": F.var_pop, "group": lambda v: F.max(F.lit(1.0)),
}


@dataclass
class Vector:
    """df has the key columns and `value`; nulls and NaN are no samples, so they aren't kept."""

    df: DataFrame
    keys: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame, keys: Sequence[str], value: str | Column = "value") -> Vector:
        v = F.col(value) if isinstance(value, str) else value
        out = df.select(*keys, v.cast("double").alias("value"))
        return cls(out.where(F.col("value").isNotNull() & ~F.isnan("value")), tuple(keys))

    def map(self, f: Callable[[Column], Column]) -> Vector:
        return Vector.of(self.df, self.keys, f(F.col("value")))

    def where(self, f: Callable[[Column], Column]) -> Vector:
        """A comparison drops series, it gives no booleans."""
        return Vector(self.df.where(f(F.col("value"))), self.keys)

    def agg(self, how: str, by: Sequence[str] = ()) -> Vector:
        made = self.df.groupBy(*by).agg(AGGREGATES[how](F.col("value")).cast("double").alias("value"))
        return Vector(made.where("value is not null"), tuple(by))

    def binary(self, other: Vector, f: Callable[[Column, Column], Column], on: Sequence[str] | None = None, nan: bool = False) -> Vector:
        """One to one on all labels, or on some; the labels of the result are those matched on. nan: results that are NaN are kept."""
        keys = tuple(on if on is not None else self.keys)
        a, b = self.df.select(*keys, F.col("value").alias("__a")), other.df.select(*keys, F.col("value").alias("__b"))
        both, value = _join(a, b, keys, "inner"), f(F.col("__a"), F.col("__b"))
        if nan:
            return Vector(both.select(*keys, value.cast("double").alias("value")).where("value is not null"), keys)
        return Vector.of(both, keys, value)

    def group_left(self, one: Vector, f: Callable[[Column, Column], Column], on: Sequence[str] = ()) -> Vector:
        """Many to one: `one` has a value for each combination of `on`, or a single one. It is an aggregate, a row for each key of on."""
        b = one.df.select(*on, F.col("value").alias("__b"))
        joined = self.df.join(b, list(on)) if on else self.df.crossJoin(F.broadcast(b.limit(2)))
        return Vector.of(joined, self.keys, f(F.col("value"), F.col("__b")))

    def and_(self, other: Vector, on: Sequence[str] | None = None) -> Vector:
        return Vector(_join(self.df, other.df.select(*(keys := tuple(self.keys if on is None else on))), keys, "left_semi"), self.keys)

    def unless(self, other: Vector, on: Sequence[str] | None = None) -> Vector:
        return Vector(_join(self.df, other.df.select(*(keys := tuple(self.keys if on is None else on))), keys, "left_anti"), self.keys)

    def or_(self, other: Vector, on: Sequence[str] | None = None) -> Vector:
        """All of self, then those of other whose labels self hasn't."""
        return Vector(self.df.unionByName(other.unless(self, on).df), self.keys)

    def top(self, k: int, by: Sequence[str] = (), largest: bool = True) -> Vector:
        """The k largest or smallest; ties by the keys. Without `by` no window is needed, only a bounded sort."""
        order = [F.desc("value") if largest else F.asc("value"), *[F.asc(c) for c in self.keys]]
        if not by:
            return Vector(self.df.orderBy(*order).limit(k), self.keys)
        n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return Vector(self.df.withColumn("__n", n).where(F.col("__n") <= k).drop("__n"), self.keys)


def _join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """On keys, null-safely; without keys on whether b has any row."""
    if not keys:
        return a.join(b.limit(1).select(F.lit(1).alias("__one")), F.lit(True), how)
    c = None
    for k in keys:
        e = a[k].eqNullSafe(b[k])
        c = e if c is None else c & e
    out = a.join(b, c, how)
    return out if how.startswith("left_") else out.drop(*[b[k] for k in keys])


def constant(spark, value: float) -> Vector:
    return Vector(spark.range(1).select(F.lit(float(value)).alias("value")), ())


def scalar(v: Vector) -> Column:
    """The value of a one-series vector, else NaN, as an aggregate expression over v.df."""
    return F.when(F.count("value") == 1, F.first("value")).otherwise(F.lit(float("nan")))


def label_replace(v: Vector, target: str, replacement: str, source: str, pattern: str) -> Vector:
    """Fully anchored; series that don't match stay as they are. replacement has $1 for groups."""
    c = F.coalesce(F.col(source).cast("string"), F.lit(""))
    own = F.col(target).cast("string") if target in v.keys else F.lit("")
    made = F.when(c.rlike(f"^(?:{pattern})$"), F.regexp_replace(c, f"^(?:{pattern})$", replacement)).otherwise(own)
    keys = v.keys if target in v.keys else (*v.keys, target)
    return Vector(v.df.withColumn(target, made), keys)


def label_join(v: Vector, target: str, separator: str, *sources: str) -> Vector:
    keys = v.keys if target in v.keys else (*v.keys, target)
    return Vector(v.df.withColumn(target, F.concat_ws(separator, *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in sources])), keys)


def series_key(labels: Column, without: Sequence[str] = ()) -> Column:
    """A label set as text: sorted k=v pairs without some labels."""
    kept = F.map_filter(labels, lambda k, v: ~k.isin(list(without))) if without else labels
    return F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def coalesce_zero(numerator: Vector, denominator: Vector) -> Vector:
    """numerator / denominator per series: 0 without a numerator, nothing for a zero or missing denominator."""
    keys = denominator.keys
    a = numerator.df.select(*keys, F.col("value").alias("__n"))
    joined = denominator.df.join(a, list(keys), "left")
    return Vector.of(joined, keys, F.coalesce("__n", F.lit(0.0)) / F.nullif(F.col("value"), F.lit(0.0)))
