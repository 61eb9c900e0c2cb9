"""Queries against their SQL on small tables of odd rows: many groups, zeros, equal times, large keys."""

import random
import tempfile
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import __spark_entry__ as entry
from opsframe.functions import cron
from opsframe.operators import interval as iv
from opsframe.sources import remote_write as rw
from opsframe.streaming import stateful
from tests.test_queries import rows

T0 = pd.Timestamp("2024-01-01")


def events(spark, some):
    """A folder with a table of events (seconds since T0, user, kind, value), in this order."""
    path = tempfile.mkdtemp(prefix="spark-")
    e = pd.DataFrame([(i, T0 + pd.Timedelta(seconds=t), u, k, v, "{}") for i, (t, u, k, v) in enumerate(some)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    e["ts"] = e["ts"].astype("datetime64[us]")
    e.to_parquet(f"{path}/events.parquet", index=False, coerce_timestamps="us")
    return path


def compared(spark, name, path, tables=("events",)):
    """(got, want): the query's rows and its SQL's."""
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    got, want = entry.queries()[name](spark, path).toPandas(), c.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    return rows(got), rows(want)


def test_more_than_ten_thousand_hosts_in_a_grouped_log_rule(spark):
    path = events(spark, [(20 * 86400 - 60 - k, u, "error", 1.0) for u in range(10_050) for k in range(3)] + [(20 * 86400 - 60, 20_000, "error", 1.0)])
    got, want = compared(spark, "ar6_log_search_grouped", path)
    assert got == want and len(got) == 10_050


def test_ratios_by_zero_and_of_halves(spark):
    hosts = [(1, 5.0, 0.0), (2, 0.0, 0.0), (3, -5.0, 0.0), (4, 5.0, -0.0), (5, 1.0, 3.0), (6, 0.0, 2.0)]
    # of these some lie at a half of the last digit: the decimal text of the double and the double times 10^4 part there
    hosts += [(10 + k, float(k * 7 % 1999) / 100, float(k % 37 + 1) / 100) for k in range(2000)]
    path = events(spark, [(60, h, kind, x) for h, view, error in hosts for kind, x in (("view", view), ("error", error))])
    got, want = compared(spark, "j1_vector_arithmetic", path)
    assert got == want and len(got) == len(hosts)


def test_sizes_and_addresses_of_large_keys(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    keys = [0, 255, 65_535, 65_536, 97_345, 1 << 24, (1 << 40) + 513]
    pd.DataFrame({"p_partkey": keys, "p_size": pd.array([1, 50, 999, 1000, 1023, 1024, 5000], dtype="int32")}).to_parquet(f"{path}/part.parquet", index=False)
    got, want = compared(spark, "fn_bytes", path, ["part"])
    assert got == want


def test_promql_ratios_by_zero_and_of_halves(spark):
    hosts = [(1, 0.0, 5.0), (2, 0.0, -5.0), (3, 3.0, 1.0), (4, 2.0, 1.0)] + [(10 + k, float(k % 37 + 1) / 100, float(k * 7 % 1999) / 100) for k in range(2000)]
    path = events(spark, [(4 * 86400 - 60, h, kind, x) for h, view, error in hosts for kind, x in (("view", view), ("error", error))])
    got, want = compared(spark, "promql_ratio_on", path)
    assert got == want and len(got) > 1000


def test_counters_take_every_sample_of_equal_times(spark):
    some = [(t, 1, kind, v) for t, kind, v in [(0, "a", 5.0), (0, "b", 1.0), (10, "a", 7.0), (10, "a", 3.0), (10, "a", 4.5), (20, "a", 4.5), (10, "b", 9.0), (400_000, "a", 1.0), (400_000, "a", 2.0), (400_000, "b", 0.0)]]
    short = [x for x in some if x[0] < 400_000]  # here the late file repeats the last time too
    for name in ("w12_counter_stream", "w12_counter_files_stream"):
        for rows_ in (some, short):
            got, want = compared(spark, name, events(spark, rows_))
            assert got == want and len(got) == len(rows_) - 2


def test_interval_counts_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    left = [(rng.choice([None, *range(30)]), a := rng.randrange(-50, 400), a + rng.choice([-1, 0, 5, 40, 130])) for _ in range(80)] + [(99, None, 5), (99, 5, None)]
    right = [(rng.choice([None, "x", "y", "z"]), rng.choice([None, *range(-60, 500)])) for _ in range(600)]
    a, b = spark.createDataFrame(left, "id long, lo long, hi long"), spark.createDataFrame(right, "kind string, t long")
    want: dict = {}
    for i, lo, hi in left:
        for kind, t in right:
            if None not in (lo, hi, t) and lo <= t <= hi:
                want[i, kind] = want.get((i, kind), 0) + 1
    for width in (7, 40, 1000):
        got = iv.interval_counts(a, b, ["id"], "lo", "hi", "t", ["kind"], width).collect()
        assert len(got) == len(want) and {tuple(r)[:2]: r["n"] for r in got} == want


def test_interval_counts_make_no_pairs(spark):
    # 20,000 intervals that all hold 20,000 rows: pairs would be 400 million
    a = spark.range(20_000).select("id", F.lit(0).cast("long").alias("lo"), (F.col("id") + 20_000).alias("hi"))
    out = iv.interval_counts(a, a.select("id", (F.col("id") % 2).alias("kind")), ["id"], "lo", "hi", "id", ["kind"], 100_000)
    assert out.count() == 40_000 and out.agg(F.sum("n")).first()[0] == 400_000_000


def test_next_fires_of_a_table_are_those_of_its_rows(spark):
    rng = random.Random(5)
    specs = ["30 2 * * *", "30 1 * * *", "*/7 * * * *", "15,45 0-4/2 * * sun", "0 0 29 2 *", "59 23 13 * 5", "@hourly", "61 * * * *", "0 0 30 2 *", None, "0 0 * * *"]
    zones = ["UTC", "Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "America/St_Johns", None]
    # minutes around changes of clocks and years, and exact ones
    near = [1_710_054_000, 1_711_846_800, 1_730_595_600, 1_712_415_600, 1_735_689_600, 1_704_067_200, 1_709_164_800]
    some = [(i, rng.choice(specs), rng.choice(zones), rng.choice([None, *near * 4]), rng.choice([0, 1, 59_999_999, rng.randrange(10**12)]) - rng.choice([0, 3 * 10**10])) for i in range(800)]
    d = spark.createDataFrame([(i, s, z, None if t is None else t * 1_000_000 + x) for i, s, z, t, x in some], "id long, spec string, zone string, at long").repartition(8)
    want = {r["id"]: r["n"] for r in d.select("id", cron.next_fire(F.col("spec"), F.col("at"), F.col("zone")).alias("n")).collect()}
    got = cron.next_fires(d, F.col("spec"), F.col("at"), F.col("zone"))
    assert got.columns == [*d.columns, "next"] and {r["id"]: r["next"] for r in got.collect()} == want and sum(x is None for x in want.values()) > 100


def test_next_fires_search_a_day_once(spark):
    # 400,000 rows of two days; a search for each would take minutes
    d = spark.range(400_000).select((F.col("id") * 432_000 + 1_709_164_800_000_000).alias("at"))
    out = cron.next_fires(d, F.lit("*/5 * * * *"), F.col("at"))
    assert out.where("next <> (at div 300000000 + 1) * 300000000 or next is null").count() == 0 and out.count() == 400_000


class Kept:
    """A list state of a test: its values, and how many were ever put."""

    def __init__(self):
        self.values, self.puts = [], 0

    def exists(self):
        return bool(self.values)

    def get(self):
        return iter(list(self.values))

    def appendList(self, values):  # noqa: N802
        self.values += values
        self.puts += len(values)

    def put(self, values):
        self.values = []
        self.appendList(values)

    def clear(self):
        self.values = []


def test_rows_wait_in_state_by_the_batch_and_come_in_order(monkeypatch):
    class Machine(stateful.InOrder):
        def begin(self, handle):
            self.steps = []

        def step(self, key, rows, clock):
            self.steps.append((len(rows), clock))
            return [r[:2] for r in rows]

    states: dict = {}
    handle = SimpleNamespace(getListState=lambda name, schema: states.setdefault(name, Kept()), registerTimer=lambda at: None)
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 9)
    monkeypatch.setattr(stateful, "STEP", 3000)
    machine = Machine(StructType().add("ts", "timestamp").add("id", "long").add("note", "string"), "ts", ["id"], [stateful.TIME, "id"])
    machine.init(handle)
    d = pd.DataFrame({stateful.TIME: [(k * 7919) % 10_000 for k in range(10_000)], "id": range(10_000), "note": [None, "x"] * 5000})
    list(machine.handleInputRows(("k",), iter([d[:5000], d[5000:]]), clock))
    assert states["inbox"].puts == 2
    out = pd.concat(machine.handleExpiredTimer(("k",), clock, None))
    assert out[stateful.TIME].tolist() == list(range(9001)) and [n for n, _ in machine.steps] == [3000, 3000, 3000, 1] and machine.steps[-1][1] == 9000
    left = [r for _, b in states["inbox"].values for r in machine._tuples(pa.ipc.open_stream(b).read_all())]
    assert sorted(r[0] for r in left) == list(range(9001, 10_000)) and {r[2] for r in left} == {None, "x"}


def test_few_samples_and_many_have_the_same_bytes(monkeypatch):
    t = np.array([0, 1, 127, 128, 1 << 41, (1 << 63) - 1, -1, -(1 << 63)] * 5, dtype=np.int64)
    v = np.array([0.0, -0.0, np.inf, 1e-300, 5.0, -7.5, np.nan, -np.inf] * 5)
    many = rw.encode_samples(t, v)
    monkeypatch.setattr(rw, "FEW", 1000)
    assert rw.encode_samples(t, v) == many and rw.encode_samples(t[:0], v[:0]) == b""
    series = rw._field(1, rw.encode_series("m", {}, t, v))
    assert [(x[2], str(x[3])) for x in rw.decode(rw.pack(series))] == [(a, str(b)) for a, b in zip(t.tolist(), v.tolist(), strict=True)]
    # the time before the value, and a field that isn't known
    odd = b"\x12\x0b\x10\x05\x09" + b"\0" * 8 + b"\x12\x0d\x09" + b"\0" * 8 + b"\x10\x07\x18\x01"
    assert [x[2:] for x in rw.decode(rw.pack(rw._field(1, odd)))] == [(5, 0.0), (7, 0.0)]
