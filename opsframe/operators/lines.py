"""Log records of several lines, from text files and from streams of lines.

A record begins at a line that matches a start pattern, or ends at one that matches an end pattern; only one of the two is
given. Lines before the first start are a record. A file is read in splits; a split numbers its own record
boundaries and a table of splits gives how many came before, so a file of any size is many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsframe.streaming.stateful import TIME, InOrder, Packed, micros, with_state

#: Characters of a record; a longer one is given in parts.
MOST = 256 * 1024


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, split, place, line): where a line's split begins in its file, and the line's place among those of its task."""
    lines = spark.read.text(list(paths))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))


def _one(start: str | None, end: str | None) -> str:
    if (start is None) == (end is None):
        raise ValueError("a start or an end pattern, and not both")
    pattern = start if start is not None else end
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"no pattern: {pattern!r}") from e
    return pattern


def records(lines: DataFrame, start: str | None = None, end: str | None = None, most: int = MOST) -> DataFrame:
    """(file, record, part, n, first, message) from read_lines(): record numbers a file's records from 0, n counts their lines.

    first is (split, place) of the first line. Messages are the lines joined by newlines; one of more than `most` characters is given in
    parts of that size, else part is 0. A last record that no end pattern closes is given too. A null line is an empty one.
    """
    pattern = _one(start, end)
    text = F.coalesce("line", F.lit(""))
    hit = text.rlike(pattern).cast("long")
    order = Window.partitionBy("file", "split").orderBy("place")
    # with an end pattern the line after a match is the one that begins a record
    marked = lines.select("file", "split", "place", text.alias("line"), hit.alias("hit"))
    before = F.sum("hit").over(order.rowsBetween(Window.unboundedPreceding, 0)) - (F.lit(0) if start is not None else F.col("hit"))
    local = marked.withColumn("local", before)
    per = marked.groupBy("file", "split").agg(F.sum("hit").alias("hits"))
    ahead = F.coalesce(F.sum("hits").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # with a start pattern the first line's own match would make its record number 1
    first = F.min_by("hit", F.struct("split", "place")) if start is not None else F.lit(0)
    splits = per.withColumn("ahead", ahead).join(marked.groupBy("file").agg(first.alias("shift")), "file")
    joined = local.join(splits.select("file", "split", (F.col("ahead") - F.col("shift")).alias("ahead")), ["file", "split"])
    made = joined.select("file", (F.col("local") + F.col("ahead")).alias("record"), F.struct("split", "place").alias("at"), "line")
    whole = made.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))
    return parts(whole.select("file", "record", F.size("x").alias("n"), F.get("x", F.lit(0))["at"].alias("first"), F.array_join(F.col("x.line"), "\n").alias("message")), most)


def parts(rows: DataFrame, most: int) -> DataFrame:
    """rows with their messages in parts of at most `most` characters."""
    last = F.floor((F.greatest(F.length("message"), F.lit(1)) - 1) / most).cast("int")
    split = rows.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    return split.withColumn("message", F.substring("message", F.col("part") * most + 1, F.lit(most)))


class _Assembler(InOrder):
    def __init__(self, schema, ts: str, order: Sequence[str], keys: Sequence[str], line: str, start: str | None, end: str | None, flush: int, most: int):
        super().__init__(schema, ts, order, [*keys, "ts", "n", "message"])
        self.line, self.start, self.end, self.flush, self.most = line, start, end, flush, most

    def begin(self, handle):
        self.lines = Packed(handle, "lines")
        self.open = handle.getValueState("open", "first long, last long, n long, size long")

    def step(self, key, rows, clock):
        first, last, n, size = self.open.get() if self.open.exists() else (None, None, 0, 0)
        held = [r[0] for r in self.lines.get()]
        out: list[tuple] = []
        matches = re.compile(self.start if self.start is not None else self.end).search

        def give() -> None:
            nonlocal first, n, size, held
            if n:
                out.append((*key, pd.Timestamp(first, unit="us"), n, "\n".join(held)))
            first, n, size, held = None, 0, 0, []

        for r in rows:
            t, line = r[self.at[TIME]], r[self.at[self.line]] or ""
            hit = matches(line) is not None
            if n and (t >= last + self.flush or (hit and self.start is not None) or size + 1 + len(line) > self.most):
                give()
            first = t if first is None else first
            last, n, size = t, n + 1, size + len(line) + (n > 0)
            held.append(line)
            if hit and self.end is not None:
                give()
        if n and clock >= last + self.flush:
            give()
        self.lines.put([(x,) for x in held])
        if n:
            self.open.update((first, last, n, size))
        else:
            self.open.clear()
        return out

    def due(self):
        return self.open.get()[1] + self.flush if self.open.exists() else None


def record_stream(lines: DataFrame, keys: Sequence[str], line: str = "line", start: str | None = None, end: str | None = None, flush: str = "500 milliseconds", most: int = MOST, late: str = "2 minutes", ts: str = "ts", order: Sequence[str] = ()) -> DataFrame:
    """(keys, ts, n, message) of a stream of lines; ts is the first line's time.

    The record that is open at the end of a batch waits in its key's state. It is given when its source has been still for
    `flush`, at its boundary, or before the line that would make it longer than `most` characters.
    """
    _one(start, end)
    machine = _Assembler(lines.schema, ts, order, keys, line, start, end, micros(flush), most)
    types = dict(lines.dtypes)
    return with_state(lines, keys, machine, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", ts timestamp, n long, message string", ts, late)
