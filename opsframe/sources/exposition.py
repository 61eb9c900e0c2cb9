"""The text exposition format of metrics, parsed with expressions; scraped targets and their limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LABEL = r"([A-Za-z_][A-Za-z0-9_]*)\s*=\s*\"((?:[^\"\\]|\\.)*)\""
_LABELS = r"\s*(?:{0}\s*(?:,\s*{0}\s*)*,?\s*)?".format(_LABEL.replace("(", "(?:").replace("(?:?:", "(?:"))
_LINE = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(" + _LABELS + r")\})?\s+([^\s]+)(?:\s+(-?[0-9]+))?\s*$"


def _unescape(v: Column) -> Column:
    # a stand-in keeps escaped backslashes apart from the other escapes
    v = F.replace(v, F.lit("\\\\"), F.lit("\x01"))
    v = F.replace(F.replace(v, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.replace(v, F.lit("\x01"), F.lit("\\"))


def _number(text: Column) -> Column:
    low = F.lower(text)
    special = F.when(low.isin("+inf", "inf"), F.lit(float("inf"))).when(low == "-inf", F.lit(float("-inf"))).when(low == "nan", F.lit(float("nan")))
    return F.coalesce(special, text.try_cast("double"))


def parse(lines: DataFrame, column: str = "value", max_line: int = 1 << 20) -> DataFrame:
    """Lines of text to (name, labels, value, ts_ms). Comments, blank lines, lines that aren't a sample and lines over max_line are left out."""
    line = F.trim(F.col(column))
    rows = lines.where((F.length(column) <= max_line) & ~line.startswith("#") & line.rlike(_LINE)).select(
        F.regexp_extract(line, _LINE, 1).alias("name"), F.regexp_extract(line, _LINE, 2).alias("raw"),
        _number(F.regexp_extract(line, _LINE, 3)).alias("value"), F.regexp_extract(line, _LINE, 4).try_cast("long").alias("ts_ms"),
    )
    keys, values = F.regexp_extract_all("raw", F.lit(_LABEL), F.lit(1)), F.regexp_extract_all("raw", F.lit(_LABEL), F.lit(2))
    return rows.where("value is not null").select("name", F.map_from_arrays(keys, F.transform(values, _unescape)).alias("labels"), "value", "ts_ms")


def scrape(samples: DataFrame, target: str, limit: int) -> DataFrame:
    """A target's samples and the synthetic `up`; over the limit only `up` = 0 remains. The limit is checked with one row more than it allows."""
    over = samples.limit(limit + 1).count() > limit
    up = samples.sparkSession.range(1).select(
        F.lit("up").alias("name"), F.create_map(F.lit("instance"), F.lit(target)).alias("labels"), F.lit(0.0 if over else 1.0).alias("value"), F.lit(None).cast("long").alias("ts_ms"),
    )
    return up if over else samples.unionByName(up)


def flatten_families(families: DataFrame) -> DataFrame:
    """Families (name, kind, labels, value, sum, count, parts: array<struct<at: double, value: double>>) to samples.

    Summaries give a `quantile` label and _sum and _count, histograms cumulative _bucket{le} with +Inf, _sum and _count.
    """
    one = lambda suffix, extra, value: F.struct(F.concat("name", F.lit(suffix)).alias("name"), extra.alias("labels"), value.cast("double").alias("value"))
    own = F.col("labels")
    text = lambda x: F.when(x == float("inf"), F.lit("+Inf")).otherwise(F.regexp_replace(x.cast("string"), r"\.0$", ""))
    tagged = lambda label, suffix: F.transform("parts", lambda p: one(suffix, F.map_concat(own, F.create_map(F.lit(label), text(p["at"]))), p["value"]))
    totals = F.array(one("_sum", own, F.col("sum")), one("_count", own, F.col("count")))
    inf = F.array(one("_bucket", F.map_concat(own, F.create_map(F.lit("le"), F.lit("+Inf"))), F.col("count")))
    bounded = F.filter(tagged("le", "_bucket"), lambda x: x["labels"]["le"] != "+Inf")
    made = F.when(F.col("kind") == "histogram", F.concat(bounded, inf, totals)).when(F.col("kind") == "summary", F.concat(tagged("quantile", ""), totals)).otherwise(F.array(one("", own, F.col("value"))))
    return families.select(F.inline(made))
