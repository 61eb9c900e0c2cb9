"""Log operators: search with keyset paging, grouped counts, histograms, context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import LogRequest


def search(logs: DataFrame, request: LogRequest, cursor: tuple[int, int] | None = None) -> DataFrame:
    """A page: limit rows in the total order (t, id), after the cursor, the (t, id) of the last row before it.

    One row more than the limit is asked for; page() takes it off and says whether there are more. The
    order is total, so records of equal time are neither lost nor repeated between pages.
    """
    rows = logs.where(request.validate().condition())
    t, i = F.col("t"), F.col("id")
    if cursor:
        at, last = cursor
        rows = rows.where((t < at) | ((t == at) & (i < last)) if request.descending else (t > at) | ((t == at) & (i > last)))
    order = (F.desc("t"), F.desc("id")) if request.descending else (F.asc("t"), F.asc("id"))
    return rows.orderBy(*order).limit(request.limit + 1)


def page(rows: DataFrame, limit: int) -> tuple[list, tuple[int, int] | None]:
    """(rows, next cursor or None) of a search."""
    got = rows.collect()
    return got[:limit], (got[limit - 1]["t"], got[limit - 1]["id"]) if len(got) > limit else None


def dimension(c: str | Column) -> Column:
    """A group's name: blank and unknown names are null."""
    v = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.when(~v.isin("", "unknown_service"), v)


def count_by(logs: DataFrame, request: LogRequest, by: Sequence[str] = (), limit: int | None = 10_000) -> DataFrame:
    """Counts in (start, end] by at most five dimensions; more than `limit` groups is an error. None: any number, for rules that look at all groups."""
    if len(by) > 5:
        raise ValueError("at most five dimensions")
    rows = logs.where(request.condition(half_open=True))
    if not by:
        return rows.agg(F.count(F.lit(1)).alias("n"))
    out = rows.groupBy(*[dimension(c).alias(c) for c in by]).agg(F.count(F.lit(1)).alias("n"))
    return out if limit is None else bounded(out, limit)


def bounded(rows: DataFrame, limit: int) -> DataFrame:
    """rows, or an error where there are more than limit of them: no partial answer."""
    if rows.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows")
    return rows


def top_values(logs: DataFrame, field: str, n: int) -> DataFrame:
    v = dimension(field)
    return logs.where(v.isNotNull()).groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def histogram(logs: DataFrame, start: int, end: int, interval: int, t: str = "t") -> DataFrame:
    """(bucket start, n): buckets aligned to `start`, zeros included, the last one shorter; a record at `end` counts in the last one."""
    buckets = -(-(end - start) // interval)
    k = F.least(F.floor((F.col(t) - start) / F.lit(interval)).cast("long"), F.lit(buckets - 1))
    n = logs.where((F.col(t) >= start) & (F.col(t) <= end)).groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    axis = logs.sparkSession.range(buckets).select(F.col("id").alias("k"))
    return axis.join(n, "k", "left").select((F.col("k") * interval + start).alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))


def context(logs: DataFrame, at: int, scope: Column, before: int = 50, after: int = 50) -> DataFrame:
    """The rows just before and just after a time in one scope; the rows at that time come after."""
    own = logs.where(scope)
    early = own.where(F.col("t") < at).orderBy(F.desc("t"), F.desc("id")).limit(before)
    return early.unionByName(own.where(F.col("t") >= at).orderBy("t", "id").limit(after))


def record_id(*columns: str) -> Column:
    """A stable id of a record's content; parts are length-prefixed, so that they can't run into each other."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def streams(logs: DataFrame, request: LogRequest, labels: Sequence[str]) -> DataFrame:
    """A range read: the request's records by label set, (labels, entries: (t, message) in the request's order), at most its limit in all."""
    order = (F.desc("t"), F.desc("id")) if request.descending else (F.asc("t"), F.asc("id"))
    rows = logs.where(request.validate().condition()).orderBy(*order).limit(request.limit)
    entries = F.sort_array(F.collect_list(F.struct("t", "id", "message")), asc=not request.descending)
    return rows.groupBy(*labels).agg(entries.alias("e")).select(*labels, F.transform("e", lambda x: F.struct(x["t"].alias("t"), x["message"].alias("message"))).alias("entries"))


def pinned(rows: DataFrame) -> DataFrame:
    """rows of the files that make up the table now: pages read from it later see no newer file. For DataFrames straight from Parquet."""
    return rows.sparkSession.read.schema(rows.schema).parquet(*rows.inputFiles())


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(t, severity_text, message) of text lines `time level message`, from a batch or a stream; a line of another form is a message alone."""
    form = r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?)Z? +([A-Za-z]+) +(.*)$"
    got = lambda i: F.nullif(F.regexp_extract(column, form, i), F.lit(""))
    return lines.select(F.unix_micros(got(1).try_cast("timestamp")).alias("t"), F.lower(got(2)).alias("severity_text"), F.coalesce(got(3), F.col(column)).alias("message"))
