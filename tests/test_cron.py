"""Next fires against a walk over minutes, over clock changes of several zones."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from opsframe.functions import cron

M = 60_000_000


def numbers(field, lo, hi, names=(), first=0):
    out = set()
    for item in field.lower().split(","):
        span, _, step = item.partition("/")
        for i, n in enumerate(names):
            span = span.replace(n, str(i + first))
        a, b = (lo, hi) if span in "*?" else (int(span.split("-")[0]), int(span.split("-")[-1]) if "-" in span or not step else hi)
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def walked(spec, at, zone, days=800):
    """Minute by minute in real time."""
    f = cron.DESCRIPTORS.get(spec, spec).split()
    minute, hour, dom, month, dow = numbers(f[0], 0, 59), numbers(f[1], 0, 23), numbers(f[2], 1, 31), numbers(f[3], 1, 12, cron.MONTHS, 1), numbers(f[4], 0, 6, cron.DAYS)
    t = datetime.fromtimestamp(at // M * 60, UTC) + timedelta(minutes=1)
    for _ in range(days * 1440):
        w = t.astimezone(ZoneInfo(zone))
        in_dom, in_dow = w.day in dom, (w.weekday() + 1) % 7 in dow
        day = in_dom and in_dow if f[2] in "*?" or f[4] in "*?" else in_dom or in_dow
        if w.minute in minute and w.hour in hour and w.month in month and day:
            return int(t.timestamp()) * 1_000_000
        t += timedelta(minutes=1)
    return None


def test_against_a_walk(spark):
    specs = ["30 2 * * *", "30 1 * * *", "0 */6 * * *", "15,45 0-4/2 * * sun", "0 9 1 * *", "0 0 31 * *", "59 23 13 * 5", "0 12 */2 * mon", "@weekly", "* * * * *", "5 3 1-7 jun,dec ?"]
    zones = ["UTC", "Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Kolkata"]
    times = [datetime(2024, 3, 9, 12, tzinfo=UTC), datetime(2024, 3, 31, 0, 59, 59, tzinfo=UTC), datetime(2024, 10, 26, 22, tzinfo=UTC), datetime(2024, 11, 3, 5, 30, tzinfo=UTC), datetime(2024, 11, 3, 6, 10, tzinfo=UTC), datetime(2024, 4, 6, 14, 45, tzinfo=UTC), datetime(2024, 2, 28, 23, 59, tzinfo=UTC)]
    rows = [(s, z, int(t.timestamp()) * 1_000_000 + 7) for s in specs for z in zones for t in times]
    d = spark.createDataFrame(rows, "spec string, zone string, at long").repartition(8)
    got = {tuple(r)[:3]: r["next"] for r in d.select("*", cron.next_fire(F.col("spec"), F.col("at"), F.col("zone")).alias("next")).collect()}
    assert got == {r: walked(r[0], r[2], r[1]) for r in rows}


def test_wrong_specifications_and_nulls(spark):
    bad = ["", "* * * *", "60 * * * *", "* 24 * * *", "* * 0 * *", "* * * 13 *", "* * * * 7", "5-1 * * * *", "*/0 * * * *", "a * * * *", "@never", "1- * * * *", None, "0 0 30 2 *"]
    out = spark.createDataFrame([(b,) for b in bad], "spec string").select(cron.next_fire(F.col("spec"), F.lit(0).cast("long")).alias("n")).collect()
    assert [r["n"] for r in out] == [None] * len(bad)
    one = spark.range(1).select(cron.next_fire(F.lit(cron.CADENCES["weekly"]), F.lit(None).cast("long")).alias("a"), cron.next_fire(F.lit("0 0 29 2 *"), F.lit(1_709_164_800_000_000)).alias("b")).first()
    assert one["a"] is None and datetime.fromtimestamp(one["b"] / 1e6, UTC) == datetime(2028, 2, 29, tzinfo=UTC)
