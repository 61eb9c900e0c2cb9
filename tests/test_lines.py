"""Records of several lines, over splits of files and over micro-batches."""

import random
import re
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from opsframe.operators import lines
from opsframe.storage import shared_folder
from opsframe.streaming.windows import read_events, run_to_end

S = 1_000_000


def assembled(text, start=None, end=None):
    out, now = [], []
    for line in text:
        if start is not None and re.search(start, line) and now:
            out.append(now)
            now = []
        now.append(line)
        if end is not None and re.search(end, line):
            out.append(now)
            now = []
    return ["\n".join(x) for x in out + ([now] if now else [])]


def texts(seed):
    rng = random.Random(seed)
    line = lambda: rng.choice(["START ", "  at ", "", "é ", "end "]) + "x" * rng.randrange(30) + rng.choice(["", ";"])
    return {f"f{i}": [line() for _ in range(n)] for i, n in enumerate((0, 1, 2, 7, 200, 50))} | {"none": ["  at a", "  at b"], "all": ["START 1;", "START 2;"]}


@pytest.mark.parametrize("split", ["64", "128m"])
@pytest.mark.parametrize("pattern", [{"start": "^START"}, {"end": ";$"}])
def test_records_over_splits(spark, split, pattern):
    folder = tempfile.mkdtemp(prefix="spark-")
    files = texts(3)
    for name, text in files.items():
        with open(f"{folder}/{name}.log", "w") as f:
            f.write("".join(x + "\n" for x in text))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        read = lines.read_lines(spark, folder)
        assert split != "64" or read.select("split").distinct().count() > 20
        got = lines.records(read, **pattern).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, text in files.items():
        own = sorted((r for r in got if r["file"].endswith(f"/{name}.log")), key=lambda r: r["record"])
        assert [r["message"] for r in own] == assembled(text, **pattern) and [r["record"] for r in own] == list(range(len(own)))
        assert sum(r["n"] for r in own) == len(text)


def test_long_records_come_in_parts(spark):
    rows = [("f", 0, i, x) for i, x in enumerate(["START abc", "defgh", None, "START"])]
    got = sorted(lines.records(spark.createDataFrame(rows, "file string, split long, place long, line string"), start="START", most=6).select("record", "part", "n", "message").collect())
    assert [tuple(r) for r in got] == [(0, 0, 3, "START "), (0, 1, 3, "abc\nde"), (0, 2, 3, "fgh\n"), (1, 0, 1, "START")]


def test_one_pattern_that_is_one():
    for more in ({}, {"start": "a", "end": "b"}, {"start": "("}):
        with pytest.raises(ValueError):
            lines.records(None, **more)


@pytest.mark.parametrize("files", [1, 6])
@pytest.mark.parametrize("pattern", [{"start": "^START"}, {"end": ";$"}])
def test_record_stream(spark, files, pattern):
    rng, rows, t = random.Random(5), [], 1_000_000_000 * S
    for i in range(250):
        t += rng.choice([S, 2 * S, 40 * S])
        rows.append((t, f"s{i % 2}", i, rng.choice(["START a", "  at b", "c;", "", None])))
    path = f"{shared_folder(spark)}/opsframe-{uuid.uuid4().hex}/in"
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, "t long, source string, id long, line string").select(F.timestamp_micros("t").alias("ts"), "source", "id", "line").coalesce(1).write.mode("append").parquet(path)
    d = read_events(spark, path, "ts timestamp, source string, id long, line string")
    out = run_to_end(lines.record_stream(d, ["source"], flush="30 seconds", most=40, order=["id"], **pattern), spark, f"{shared_folder(spark)}/opsframe-{uuid.uuid4().hex}", "out")
    got = sorted((r["source"], int(r["ts"].timestamp() * S + 0.5), r["n"], r["message"]) for r in out.collect())
    mark, want = rows[-1][0] - 120 * S, []
    for source in ("s0", "s1"):
        now = []
        for at, _, _, line in [r for r in rows if r[1] == source and r[0] <= mark]:
            line, size = line or "", len("\n".join(x for _, x in now))
            if now and (at >= now[-1][0] + 30 * S or ("start" in pattern and line.startswith("START")) or size + 1 + len(line) > 40):
                want.append((source, now))
                now = []
            now = [*now, (at, line)]
            if "end" in pattern and line.endswith(";"):
                want.append((source, now))
                now = []
        if now and mark >= now[-1][0] + 30 * S:
            want.append((source, now))
    assert got == sorted((s, x[0][0], len(x), "\n".join(line for _, line in x)) for s, x in want)
