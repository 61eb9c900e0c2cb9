"""The wire format by its bytes, round trips, caps, and the source's commits."""

import glob
import math
import struct
import tempfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opsframe.sources import remote_write as rw


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _t) for i, _t in enumerate(rw._KINDS.types)], schema=rw._KINDS)


def through(rows, **more):
    return [r for body, _ in rw.bodies(batch([(n, list(lab.items()), t, v) for n, lab, t, v in rows]), **more) for r in rw.decode(body)]


def test_bytes_of_a_message():
    raw = rw.unpack(next(rw.bodies(batch([("up", [("job", "a")], 1, 2.0), ("up", [("job", "a")], 300, 0.0)])))[0])
    label = lambda k, v: b"\x0a" + bytes([len(k) + len(v) + 4]) + b"\x0a" + bytes([len(k)]) + k + b"\x12" + bytes([len(v)]) + v
    series = label(b"__name__", b"up") + label(b"job", b"a") + b"\x12\x0b\x09" + struct.pack("<d", 2.0) + b"\x10\x01" + b"\x12\x0c\x09" + struct.pack("<d", 0.0) + b"\x10\xac\x02"
    assert raw == b"\x0a" + bytes([len(series)]) + series


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=5), st.dictionaries(st.text(max_size=4).filter(lambda k: k != "__name__"), st.text(max_size=4), max_size=3), st.integers(-(1 << 63), (1 << 63) - 1), st.floats(allow_nan=False)), max_size=30), st.sampled_from([1, 64, 1 << 20]))
def test_round_trip(rows, target):
    key = lambda r: (r[0], sorted(r[1].items()), r[2], r[3])
    assert sorted(map(key, through(rows, target=target))) == sorted(map(key, rows))


def test_samples_by_numbers_of_all_lengths():
    t = np.array([0, 1, 127, 128, 1 << 41, (1 << 63) - 1, -1], dtype=np.int64)
    v = np.array([0.0, -0.0, math.inf, 1e-300, 5.0, -7.5, math.nan])
    want = b""
    for a, b in zip(t.tolist(), v.tolist(), strict=True):
        inner = b"\x09" + struct.pack("<d", b) + (b"\x10" + rw.varint(a) if a else b"")
        want += b"\x12" + bytes([len(inner)]) + inner
    assert rw.encode_samples(t, v) == want


def test_caps_and_broken_bodies(spark):
    good = next(rw.bodies(batch([("m", [], k, 1.0) for k in range(1000)])))[0]
    bomb = rw.pack(b"\x00" * (1 << 20))
    assert len(bomb) < 1 << 17
    with pytest.raises(rw.WireError, match="more than"):
        rw.unpack(bomb, 1 << 19)
    lie = rw.varint(1 << 40) + bomb[3:]
    for body in (lie, b"", b"\x05abc", rw.pack(b"\x0a\x7f\x01"), rw.pack(b"\x0b"), rw.pack(b"\x0a\x04\x0a\x02\x0a\xff"), rw.pack(b"\xff" * 12)):
        with pytest.raises(rw.WireError):
            rw.decode(body, 1 << 20)
    rows = [(1, good), (2, bomb), (3, None), (4, b"junk")]
    got = rw.decoded(spark.createDataFrame(rows, "id int, body binary"), most=1 << 19).groupBy(F.col("problem").isNotNull().alias("bad")).count().collect()
    assert {r["bad"]: r["count"] for r in got} == {False: 1000, True: 2}
    assert rw.decode(rw.pack(b"\x18\x07\x22\x01x")) == []  # fields that aren't known


def test_a_task_that_runs_twice_doubles_nothing(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    writer = rw._Writer(path, 200)
    rows = [batch([("m", [("host", str(k % 3))], k, float(k)) for k in range(100)])]
    first, again, other = writer.write(iter(rows)), writer.write(iter(rows)), writer.write(iter([]))
    writer.commit([again, other, None])  # the first attempt's file stays, and nothing names it
    rw.register(spark)
    read = lambda: spark.read.format("remote_write").option("path", path).load()
    assert first.file != again.file and other.file is None and again.bodies > 10 and again.samples == 100
    assert read().count() == 100 and read().agg(F.sum("value")).first()[0] == sum(range(100))
    lost = writer.write(iter(rows))
    writer.abort([lost, other])
    assert not glob.glob(f"{path}/{lost.file}") and read().count() == 100


def test_write_and_read_with_spark(spark):
    rw.register(spark)
    path = "file://" + tempfile.mkdtemp(prefix="spark-")
    rows = [("m", {"a": "1"}, 5, 1.5), ("m", {}, 6, math.nan), ("n", None, 7, 0.0), (None, {"é": ""}, -8, -1.0), ("gone", {}, None, 1.0), ("gone", {}, 9, None)]
    frame = spark.createDataFrame(rows, rw.SCHEMA)
    frame.write.format("remote_write").option("path", path).mode("append").save()
    spark.createDataFrame([], rw.SCHEMA).write.format("remote_write").option("path", path).mode("append").save()
    frame.limit(1).write.format("remote_write").option("path", path).mode("append").save()
    got = sorted(((r["name"], r["labels"], r["t"], str(r["value"])) for r in spark.read.format("remote_write").option("path", path).load().collect()), key=str)
    assert len(got) == 5 and ("m", {}, 6, "nan") in got and ("", {"é": ""}, -8, "-1.0") in got and ("n", {}, 7, "0.0") in got
    empty = spark.read.format("remote_write").option("path", tempfile.mkdtemp(prefix="spark-")).load()
    assert empty.count() == 0
    for bad in (frame.select("name", "t"), frame):
        with pytest.raises(Exception, match="columns are|never overwritten|appended"):
            bad.write.format("remote_write").option("path", path).mode("append" if bad is not frame else "overwrite").save()
