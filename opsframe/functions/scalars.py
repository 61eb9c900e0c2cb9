"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of log levels, and the severity number where each level begins.
LEVELS = {"trace": ["trace"], "debug": ["debug", "dbg"], "info": ["info", "information", "notice"], "warn": ["warn", "warning"], "error": ["error", "err"], "fatal": ["fatal", "critical", "crit", "panic", "emerg", "alert"]}
SEVERITY_NUMBER = {"trace": 1, "debug": 5, "info": 9, "warn": 13, "error": 17, "fatal": 21}
#: The letters that klog lines begin with.
KLOG = {"I": "info", "W": "warn", "E": "error", "F": "fatal"}


def level(c: Column) -> Column:
    """The normal spelling of a level; null if it isn't one."""
    low = F.lower(F.trim(c))
    out = F.lit(None).cast("string")
    for name, words in LEVELS.items():
        out = F.when(low.isin(words), name).otherwise(out)
    return out


def detect_level(message: Column) -> Column:
    """A message's level: its JSON `level` or `severity`, a klog prefix, else the first level word in it."""
    j = F.coalesce(F.get_json_object(message, "$.level"), F.get_json_object(message, "$.severity"))
    letter = F.regexp_extract(message, r"^([IWEF])[0-9]{4} [0-9]{2}:", 1)
    klog = F.lit(None).cast("string")
    for k, v in KLOG.items():
        klog = F.when(letter == k, v).otherwise(klog)
    words = [w for ws in LEVELS.values() for w in ws]
    return F.coalesce(level(j), klog, level(F.regexp_extract(F.lower(message), rf"\b({'|'.join(words)})\b", 1)))


def severity_number(c: Column) -> Column:
    out = F.lit(0)
    for name, n in SEVERITY_NUMBER.items():
        out = F.when(level(c) == name, n).otherwise(out)
    return out


def path_prefixes(path: Column) -> Column:
    """a/b/c to [a, a/b, a/b/c]; empty parts don't count."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def normal_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")))


def csv_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def mac(c: Column) -> Column:
    """Twelve hex digits as aa:bb:..; null otherwise."""
    h = F.lower(F.regexp_replace(c, "[^0-9A-Fa-f]", ""))
    return F.when(F.length(h) == 12, F.regexp_replace(h, "(..)(?=.)", "$1:"))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def delta_percent(now: Column, before: Column) -> Column:
    """Change in percent to one digit; null for a zero or missing base."""
    return F.round((now - before) / F.nullif(before, F.lit(0).cast("double")) * 100, 1)


def divided(a: Column, b: Column) -> Column:
    """a / b of doubles by IEEE rules: infinite for a zero divisor, NaN for 0 / 0. Plain division is an error there."""
    b = b.cast("double")
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).otherwise(a * F.pow(b, F.lit(-1.0)))


def rounded(c: Column, digits: int) -> Column:
    """A double times 10^digits, halves away from zero, and back, as SQL engines in C do it; round() would go by the double's decimal text."""
    by = F.lit(10.0**digits)
    whole = F.round(c * by, 0)
    return F.when(F.abs(whole) < float("inf"), whole / by).otherwise(c)


def finite(c: Column) -> Column:
    return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)


def minutes_between(a: Column, b: Column) -> Column:
    """Minutes from a to b in microseconds; negative spans count 0."""
    return F.greatest((b - a) / F.lit(60_000_000), F.lit(0.0))


def human_bytes(c: Column) -> Column:
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
    out = F.concat(F.regexp_replace(F.format_number(c.cast("double"), 0), ",", ""), F.lit(" B"))
    for i, u in enumerate(units[1:], 1):
        out = F.when(c >= 1024**i, F.concat(F.regexp_replace(F.format_number(c / 1024**i, 1), ",", ""), F.lit(f" {u}"))).otherwise(out)
    return out


def ip_little_endian(c: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(c.cast("long"), 8 * i).bitwiseAND(F.lit(255)).cast("string") for i in range(4)])


def md5_id(c: Column) -> Column:
    """The first 64 bits of the md5, unsigned, so a decimal."""
    return F.conv(F.substring(F.md5(c), 1, 16), 16, 10).cast("decimal(20,0)")


def fingerprint(*parts: Column) -> Column:
    p = [F.coalesce(x.cast("string"), F.lit("")) for x in parts]
    return F.sha2(F.concat(*[F.concat(F.length(x).cast("string"), F.lit(":"), x) for x in p]), 256)


def normal_stack(c: Column) -> Column:
    """A stack without addresses, offsets and goroutine numbers, so that equal failures are equal."""
    lines = F.transform(F.split(c, "\n"), lambda s: F.regexp_replace(F.regexp_replace(F.trim(s), r"0x[0-9a-f]+|\+0x[0-9a-f]+", "?"), r"^goroutine \d+", "goroutine ?"))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def first_of(columns: Sequence[str], attributes: str) -> Column:
    """The first non-empty of several attribute keys."""
    return F.coalesce(*[F.nullif(F.col(attributes)[k], F.lit("")) for k in columns])


def redact(c: Column) -> Column:
    """Values of secret keys and bearer tokens are hidden."""
    c = F.regexp_replace(c, r"(?i)\b(password|passwd|token|secret|api[_-]?key)(\s*[=:]\s*)([^\s,;\"]+)", "$1$2***")
    return F.regexp_replace(c, r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]+=*", "Bearer ***")


def redact_map(m: Column) -> Column:
    return F.transform_values(m, lambda k, v: F.when(k.rlike("(?i)password|passwd|token|secret|api[_-]?key"), "***").otherwise(redact(v)))


def period(ts: Column, kind: str) -> Column:
    """Label of a report's day, ISO week or month."""
    d = ts.cast("date")
    if kind == "day":
        return F.date_format(d, "yyyy-MM-dd")
    if kind == "month":
        return F.date_format(d, "yyyy-MM")
    year = F.year(F.date_add(F.date_trunc("week", d).cast("date"), 3))
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def coalesce_usage(values: Column) -> tuple[Column, Column]:
    """(the agreed value, conflict): values from several keys that differ are a conflict and give null."""
    kinds = F.array_distinct(F.filter(values, lambda v: v.isNotNull()))
    return F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))), F.size(kinds) > 1
