"""What happens to telemetry on its way in: checks, batches under a byte budget, enrichment and new names."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other names of metrics and the keys of a resource that services are told by.
RENAMED = {"grpc.server.duration": "rpc.server.duration", "grpc.client.duration": "rpc.client.duration"}


def split_valid(rows: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters with `reason`: the first check that is not true)."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(checks.items()):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    told = rows.withColumn("reason", reason)
    return told.where("reason is null").drop("reason"), told.where("reason is not null")


def batches(rows: DataFrame, source: str, order: Sequence[str], size: Column, most_rows: int, most_bytes: int, base: int = 0) -> DataFrame:
    """rows with `batch`, from 0 within a source: in order, a batch is closed before a row that would bring it over a limit.

    size is a row's encoded bytes; rows after the first of a batch cost one byte more, `base` is a batch's own. A row
    that is too large alone has the null batch. A source is read as a sorted stream, a number at a time.
    """
    if most_rows < 1 or most_bytes <= base:
        raise ValueError("limits must allow a row")
    flat = rows.withColumn("__size", size.cast("long")).repartition(source).sortWithinPartitions(source, *order)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, n, used = object(), 0, 0, base
        for p in parts:
            out: list[int | None] = []
            for s, z in zip(p[source].tolist(), p["__size"].tolist(), strict=True):
                if s != now and not (pd.isna(s) and pd.isna(now)):
                    now, batch, n, used = s, 0, 0, base
                if base + z > most_bytes:
                    out.append(None)
                    continue
                if n and (n >= most_rows or used + 1 + z > most_bytes):
                    batch, n, used = batch + 1, 0, base
                used += z + (1 if n else 0)
                n += 1
                out.append(batch)
            yield p.drop(columns="__size").assign(batch=pd.array(out, dtype="Int64"))

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return flat.mapInPandas(run, f"{schema}, batch long")


def enrich(spans: DataFrame, fixed: Mapping[str, str], resource: str = "resource") -> DataFrame:
    """The resource map with keys of the collecting host; what a resource says itself wins, and an empty environment counts as missing."""
    own = F.map_filter(resource, lambda k, v: (k != "deployment.environment.name") | (F.coalesce(v, F.lit("")) != ""))
    more = F.map_filter(F.create_map(*[F.lit(x) for pair in fixed.items() for x in pair]), lambda k, _: ~F.map_contains_key(own, k))
    return spans.withColumn(resource, F.map_concat(own, more))


def rename(metrics: DataFrame, column: str = "name", names: Mapping[str, str] = RENAMED) -> DataFrame:
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return metrics.withColumn(column, F.coalesce(known[F.col(column)], F.col(column)))


def rekey(spans: DataFrame, identity: Sequence[str], resource: str = "resource") -> DataFrame:
    """A group key of trace and resource identity: services that share a trace id are sampled apart. trace_id stays as it is."""
    parts = [F.coalesce(F.col(resource)[k], F.lit("")) for k in identity]
    return spans.withColumn("group_key", F.concat_ws("|", "trace_id", *parts))
