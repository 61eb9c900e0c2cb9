"""Error groups: failed spans by what fails, whatever the addresses in their stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def stack_key(c: Column) -> Column:
    """A stack without what differs between equal failures: routine headers, argument addresses, program counters.

    Only stacks that begin with a routine header are changed; source lines stay, as other lines may be other failures.
    """
    before = lambda line, mark: F.substring_index(line, mark, 1)

    def frame(line: Column) -> Column:
        call = line.endswith(")") & line.contains("(")
        return F.when(line.startswith("created by "), before(line, " in goroutine ")).when(line.contains(".go:"), before(line, " +0x")).when(call, F.regexp_replace(line, r"\([^(]*$", "")).otherwise(line)

    lines = F.transform(F.split(c, "\n"), _trimmed)
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("goroutine "))
    return F.when(c.startswith("goroutine "), F.array_join(F.transform(kept, frame), "\n")).otherwise(c)


def fingerprint(operation: Column, kind: Column, status: Column, stack: Column) -> Column:
    """The SHA-256 of what tells one failure from another, as a JSON list of strings."""
    parts = [F.coalesce(x.cast("string"), F.lit("")) for x in (operation, kind, status, stack_key(_trimmed(F.regexp_replace(stack, "\r\n", "\n"))))]
    return F.sha2(F.to_json(F.array(*parts)).cast("binary"), 256)


def groups(failures: DataFrame) -> DataFrame:
    """failures (operation, error_type, status, stack, t, version, instance, trace_id, span_id) by fingerprint.

    A span counts once. The latest failure stands for its group, of equal times that with the greater (trace_id, span_id).
    """
    f = failures.dropDuplicates(["trace_id", "span_id"]).withColumn("fingerprint", fingerprint(F.col("operation"), F.col("error_type"), F.col("status"), F.col("stack")))
    latest = F.max_by(F.struct("trace_id", "span_id", "stack"), F.struct("t", "trace_id", "span_id"))
    named = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}s")
    out = f.groupBy("fingerprint", "operation", "error_type", "status").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), named("version"), named("instance"), latest.alias("x"))
    return out.select("*", "x.*").drop("x")
