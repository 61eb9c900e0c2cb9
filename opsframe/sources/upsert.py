"""Sinks by key: latest row wins, deletion by filter or reference, change streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in this order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], do_nothing: bool = False) -> DataFrame:
    """ON CONFLICT DO UPDATE, or DO NOTHING: target with the changes, whose own keys must be unique."""
    if do_nothing:
        return target.unionByName(changes.join(target.select(*keys), list(keys), "left_anti"))
    return target.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes)


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true; null counts as not true."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def delete_keys(target: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return target.join(keys.select(*on).distinct(), list(on), "left_anti")


def apply_changes(changes: DataFrame, keys: Sequence[str], seq: str, op: str = "op") -> DataFrame:
    """A change stream's state: the last operation of each key, without deleted keys."""
    return latest(changes, keys, [F.col(seq).desc()]).where(F.col(op) != "delete").drop(op)


def write_partitioned(df: DataFrame, path: str, by: str, max_records: int = 1_000_000) -> None:
    """Parquet by a partition column, with bounded files; the sink of samples, and of foreachBatch."""
    df.write.mode("append").partitionBy(by).option("maxRecordsPerFile", max_records).option("compression", "snappy").parquet(path)
