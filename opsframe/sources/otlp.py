"""Trace exports as JSON: resource, scope and span levels to one row per span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_SPAN = (
    f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,"
    f"attributes:{_ATTRS},status:struct<code:string,message:string>,events:array<struct<name:string,timeUnixNano:string,attributes:{_ATTRS}>>>"
)
_BATCH = f"struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<{_SPAN}>>>>"
SCHEMA = f"struct<resourceSpans:array<{_BATCH}>,batches:array<{_BATCH}>>"


def attributes(a: Column) -> Column:
    """A list of typed attributes as a map of strings; the last of equal keys wins."""
    v = lambda x: F.coalesce(x["value"]["stringValue"], x["value"]["intValue"], x["value"]["doubleValue"].cast("string"), x["value"]["boolValue"].cast("string"))
    a = F.coalesce(a, F.array().cast(_ATTRS))
    last = F.filter(a, lambda x, i: ~F.exists(F.slice(a, i + 2, F.greatest(F.size(a) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], v(x))))


def canonical_id(x: Column, width: int) -> Column:
    """Lower-case hex, padded on the left where leading zeros were stripped; null if it isn't hex or is all zeros."""
    low = F.lower(F.trim(x))
    ok = low.rlike(f"^[0-9a-f]{{1,{width}}}$") & ~low.rlike("^0+$")
    return F.when(ok, F.lpad(low, width, "0"))


def spans(documents: DataFrame, column: str = "value") -> DataFrame:
    """Spans of trace exports, which hold `resourceSpans` or `batches`; the first of equal span ids of a trace stays. Bad JSON gives no row."""
    j = documents.select(F.from_json(column, SCHEMA).alias("j"))
    b = j.select(F.explode(F.coalesce("j.resourceSpans", "j.batches")).alias("b"))
    s = b.select(F.col("b.resource.attributes").alias("r"), F.explode("b.scopeSpans").alias("s"))
    s = s.select("r", F.col("s.scope.name").alias("scope"), F.explode("s.spans").alias("x"))
    out = s.select(
        canonical_id(F.col("x.traceId"), 32).alias("trace_id"), canonical_id(F.col("x.spanId"), 16).alias("span_id"), canonical_id(F.col("x.parentSpanId"), 16).alias("parent_span_id"),
        F.col("x.name").alias("name"), F.col("x.kind").alias("kind"), F.col("x.startTimeUnixNano").cast("long").alias("start_ns"), F.col("x.endTimeUnixNano").cast("long").alias("end_ns"),
        F.col("x.status.code").alias("status"), attributes(F.col("x.attributes")).alias("attributes"), attributes(F.col("r")).alias("resource"), "scope", F.col("x.events").alias("events"),
    )
    return out.where("trace_id is not null and span_id is not null").dropDuplicates(["trace_id", "span_id"])
