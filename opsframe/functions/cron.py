"""The next time of a cron schedule, as a column expression: specifications, zones and times may all be columns.

A specification has five fields, minute hour day-of-month month day-of-week, of lists, ranges, steps and names, or is a
descriptor such as @daily. Where neither day field is a plain star a day that fits either will do, else it must fit both. Schedules
run by the wall clock of their zone: a time that the clock skips doesn't come, one that it shows twice comes twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Descriptors, names, and the bounds of the fields.
DESCRIPTORS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
BOUNDS = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 6)]
#: What a report of each cadence runs at.
CADENCES = {"daily": "0 9 * * *", "weekly": "0 9 * * 1", "monthly": "0 9 1 * *"}
MINUTE, DAY = 60_000_000, 86_400_000_000
#: Years that are searched after the current one, and days that are looked at first.
YEARS, NEAR = 5, 62
_ITEM = r"(\*|\?|\d+(-\d+)?)(/\d+)?"


def let(value: Column, f) -> Column:
    """f(value), where value is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fields(spec: Column) -> Column:
    """The five fields, names as numbers; null if it isn't a specification."""
    text = F.trim(F.lower(spec))
    for name, full in DESCRIPTORS.items():
        text = F.when(text == name, full).otherwise(text)
    parts = F.split(text, r"\s+")

    def numbers(of: Column, names: list[str], first: int) -> Column:
        for i, n in enumerate(names):
            of = F.regexp_replace(of, rf"\b{n}\b", str(i + first))
        return of

    five = F.array(*[F.get(parts, F.lit(i)) for i in range(3)], numbers(F.get(parts, F.lit(3)), MONTHS, 1), numbers(F.get(parts, F.lit(4)), DAYS, 0))
    return F.when((F.size(parts) == 5) & F.forall(five, lambda x: x.rlike(f"^{_ITEM}(,{_ITEM})*$")), five)


def _values(field: Column, lo: int, hi: int) -> Column:
    """The numbers of a field; null where one is out of its bounds or a range runs down."""

    def item(x: Column) -> Column:
        span, step = F.get(F.split(x, "/"), F.lit(0)), F.get(F.split(x, "/"), F.lit(1)).cast("int")
        star, ends = span.isin("*", "?"), F.split(span, "-")
        a = F.when(star, lo).otherwise(F.get(ends, F.lit(0)).try_cast("int"))
        b = F.when(star, hi).otherwise(F.coalesce(F.get(ends, F.lit(1)).try_cast("int"), F.when(step.isNotNull(), hi).otherwise(a)))
        s = F.coalesce(step, F.lit(1))
        good = (a >= lo) & (b <= hi) & (a <= b) & (s > 0)
        return F.when(good, F.sequence(a, F.when(good, b).otherwise(a), F.when(good, s).otherwise(F.lit(1))))

    all_of = F.transform(F.split(field, ","), item)
    return F.when(F.forall(all_of, lambda x: x.isNotNull()), F.array_sort(F.array_distinct(F.flatten(all_of))))


def _starred(field: Column) -> Column:
    return F.exists(F.split(field, ","), lambda x: x.rlike(r"^[*?](/0*1)?$"))


def _parsed(spec: Column) -> Column:
    return let(fields(spec), lambda f: F.struct(*[_values(F.get(f, F.lit(i)), *BOUNDS[i]).alias(f"f{i}") for i in range(5)], _starred(F.get(f, F.lit(2))).alias("dom"), _starred(F.get(f, F.lit(4))).alias("dow")))


def _whole(p: Column) -> Column:
    return F.forall(F.array(*[F.size(p[f"f{i}"]) for i in range(5)]), lambda n: n > 0)


def _local(us: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def _today(at: Column, zone: Column) -> Column:
    return F.floor(_local(at, zone) / F.lit(DAY)).cast("int")


def _days(p: Column, today: Column, days: int) -> Column:
    """The first days that fit, from today on: the current day, one that a clock change spoils, and one after it."""
    year = F.year(F.date_from_unix_date(today))

    def fits(day: Column) -> Column:
        d = F.date_from_unix_date(day)
        dom, dow = F.array_contains(p["f2"], F.dayofmonth(d)), F.array_contains(p["f4"], F.dayofweek(d) - 1)
        return F.array_contains(p["f3"], F.month(d)) & F.when(p["dom"] | p["dow"], dom & dow).otherwise(dom | dow) & (F.year(d) <= year + YEARS)

    return F.slice(F.filter(F.sequence(today, today + days), fits), 1, 3)


def _shown(p: Column, some: Column, zone: Column) -> Column:
    """The instants of the fires on some days."""
    instant = lambda us: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(us), zone))
    slots = F.flatten(F.transform(p["f1"], lambda h: F.transform(p["f0"], lambda m: h * 60 + m)))
    walls = F.flatten(F.transform(some, lambda d: F.transform(slots, lambda s: d.cast("long") * DAY + s.cast("long") * MINUTE)))
    # a wall time is the instant that shows it, and the later one too where the clock goes back
    return F.flatten(F.transform(walls, lambda w: let(instant(w), lambda i: F.filter(F.array(i, i + 30 * MINUTE, i + 60 * MINUTE), lambda x: _local(x, zone) == w))))


def next_fire(spec: Column, at: Column, zone: Column | str = "UTC") -> Column:
    """Microseconds of the first fire after at (microseconds), within YEARS years; null for a null, a wrong specification, or if there is none.

    About a millisecond a row: for schedules. next_fires() is for tables of events.
    """
    zone = F.lit(zone) if isinstance(zone, str) else zone

    def search(p: Column) -> Column:
        first = lambda days: F.array_min(F.filter(_shown(p, _days(p, _today(at, zone), days), zone), lambda x: x > at))
        return F.coalesce(first(NEAR), first((YEARS + 1) * 366))

    return F.when(at.isNotNull() & zone.isNotNull(), let(_parsed(spec), lambda p: F.when(_whole(p), search(p))))


def next_fires(rows: DataFrame, spec: Column, at: Column, zone: Column | str = "UTC", name: str = "next") -> DataFrame:
    """rows with next_fire() in a column `name`; an own column of that name is replaced.

    Each different specification, zone and day is searched once and gives the next fire after each of the day's minutes; rows
    are joined to it and take that of their minute. Its rows are as many as those days, whatever the rows of a day.
    """
    own = ["__spec", "__zone", "__today", "__day"]
    zone = F.lit(zone) if isinstance(zone, str) else zone
    keyed = rows.withColumns({"__spec": spec, "__zone": zone, "__at": at.cast("long")})
    # a day by UTC as minutes are counted in it, and one by the zone's clock as schedules are
    keyed = keyed.withColumns({"__today": _today(F.col("__at"), F.col("__zone")), "__day": F.floor(F.col("__at") / F.lit(DAY)).cast("long")})
    days = keyed.select(*own).dropna().distinct().repartition(rows.sparkSession.sparkContext.defaultParallelism, *own)

    def fires(p: Column) -> Column:
        some = lambda days_: _days(p, F.col("__today"), days_)
        near = let(some(NEAR), lambda d: F.when(F.size(d) == 3, d))
        return F.array_sort(F.array_distinct(_shown(p, F.coalesce(near, some((YEARS + 1) * 366)), F.col("__zone"))))

    # how many of the day's minutes begin before a fire
    upto = lambda f: F.least(F.greatest(F.ceil((f - F.col("__day") * DAY) / F.lit(MINUTE)), F.lit(0)), F.lit(1441)).cast("int")
    spread = lambda f: F.flatten(F.transform(f, lambda x, i: F.array_repeat(x, upto(x) - F.coalesce(upto(F.get(f, i - 1)), F.lit(0)))))
    table = days.select(*own, let(_parsed(F.col("__spec")), lambda p: F.when(_whole(p), let(fires(p), spread))).alias("__after"))
    joined = keyed.join(table, own, "left")
    minute = F.floor((F.col("__at") - F.col("__day") * DAY) / F.lit(MINUTE)).cast("int")
    one, two = F.get("__after", minute), F.get("__after", minute + 1)
    return joined.withColumn(name, F.when(one > F.col("__at"), one).otherwise(two)).drop(*own, "__at", "__after")
