"""Stateful streams over several files against plain loops: long-lived traces, queues with failing sinks, watch triggers."""

import random
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from opsframe.plans.q_state import sent_unless_hashed
from opsframe.storage import shared_folder
from opsframe.streaming import stateful
from opsframe.streaming.windows import read_events, run_to_end

S = 1_000_000
#: A row at the epoch would not be later than a watermark that has not begun.
BASE = 1_000_000_000 * S
LATE = 120 * S


def streamed(spark, rows, schema, files):
    """rows (t in microseconds first) in order of time, dealt to files, one a batch."""
    path = f"{shared_folder(spark)}/opsframe-{uuid.uuid4().hex}/in"
    rows = sorted(((r[0] + BASE, *r[1:]) for r in rows), key=lambda r: r[0])
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, f"t long, {schema}").select(F.timestamp_micros("t").alias("ts"), *[c.split()[0] for c in schema.split(",")]).coalesce(1).write.mode("append").parquet(path)
    return read_events(spark, path, f"ts timestamp, {schema}")


def ended(spark, stream, schema=None):
    out = run_to_end(stream, spark, f"{shared_folder(spark)}/opsframe-{uuid.uuid4().hex}", "out")
    return out


def mark(rows):
    return max(r[0] for r in rows) // 1000 * 1000 - LATE


# --- tail sampling -----------------------------------------------------------------------------------


def sampled(rows, wait, remember):
    kept, clock, by = [], mark(rows), {}
    for r in sorted(rows):
        by.setdefault(r[1], []).append(r)
    for own in by.values():
        own = [r for r in own if r[0] <= clock]
        while own:
            part, rest = [own[0]], own[1:]
            # a trace goes on until `remember` after a span of it, once it is decided
            while rest:
                first = part[0][0]
                bad = [r for r in part if r[3] and r[0] <= first + wait]
                decided = bool(bad) or rest[0][0] > first + wait
                if decided and rest[0][0] > part[-1][0] + remember and (bad or part[-1][0] > first + wait or rest[0][0] > first + wait):
                    if bad or part[-1][0] > first + wait:
                        break
                part.append(rest.pop(0))
            first = part[0][0]
            if not any(r[3] and r[0] <= first + wait for r in part) and clock > first + wait:
                kept += part
            own = rest
    return sorted(r[:3] for r in kept)


@pytest.mark.parametrize("files", [1, 5])
def test_decisions_outlive_the_wait(spark, files):
    rows = [(0, "a", 1, True), (1 * S, "a", 2, False), (7200 * S, "a", 3, False), (9000 * S, "a", 4, True)]  # dropped for good
    rows += [(0, "b", 5, False), (31 * S, "b", 6, True), (7300 * S, "b", 7, None)]  # sampled: what comes later can't undo it
    rows += [(5 * S, "c", 8, False), (35 * S, "c", 9, True)]  # the last moment of the wait
    rows += [(100 * S, None, 10, False), (20_000 * S, "end", 11, False)]
    d = streamed(spark, rows, "trace_id string, id long, sdk boolean", files)
    out = ended(spark, stateful.tail_sample(d, "sdk", remember="3 hours", order=["id"]))
    got = sorted((r["trace_id"] or "", r["id"]) for r in out.collect())
    assert got == [("", 10), ("b", 5), ("b", 6), ("b", 7)]
    assert out.columns == ["ts", "trace_id", "id", "sdk"]


def test_decisions_are_forgotten_and_large_traces_dropped(spark):
    rows = [(0, "a", 1, True), (2000 * S, "a", 2, False), (2100 * S, "a", 3, False), (9000 * S, "end", 4, False)]
    rows += [(k * S, "large", 100 + k, False) for k in range(6)]
    d = streamed(spark, rows, "trace_id string, id long, sdk boolean", 3)
    out = ended(spark, stateful.tail_sample(d, "sdk", remember="10 minutes", order=["id"], most=5))
    assert sorted((r["trace_id"], r["id"]) for r in out.collect()) == [("a", 2), ("a", 3)]


@pytest.mark.parametrize(("seed", "files"), [(1, 1), (1, 4), (2, 7)])
def test_tail_sampling_against_a_loop(spark, seed, files):
    rng = random.Random(seed)
    rows = [(rng.randrange(20_000) * S + i, f"t{rng.randrange(12)}", i, rng.random() < 0.1) for i in range(300)]
    d = streamed(spark, rows, "trace_id string, id long, sdk boolean", files)
    out = ended(spark, stateful.tail_sample(d, "sdk", wait="10 minutes", remember="1000 days", order=["id"]))
    got = sorted((int(r["ts"].timestamp() * S + 0.5) - BASE, r["trace_id"], r["id"]) for r in out.collect())
    assert got == sampled(rows, 600 * S, 1 << 60)


# --- queue -------------------------------------------------------------------------------------------


def simulated(rows, key, size, flush, most, backoffs, clock):
    """A second by second loop over one key's rows, without the queue's own code."""
    queue, busy, out, batch = [], None, [], 0
    todo = [r for r in sorted(rows) if r[0] <= clock]

    def attempt(at):
        nonlocal busy
        rows_, number, n = busy[:3]
        n += 1
        if sent_unless_hashed((key,), number, n, rows_):
            out.extend((r[2], number, n, "sent", at) for r in rows_)
        elif n > len(backoffs):
            out.extend((r[2], number, n, "dead", at) for r in rows_)
        else:
            busy = (rows_, number, n, at + backoffs[n - 1])
            return
        busy = None
        if len(queue) >= size:
            close(at)

    def close(at):
        nonlocal busy, batch
        batch += 1
        busy = (queue[:size], batch, 0, at)
        del queue[:size]
        attempt(at)

    def until(at):
        while True:
            if busy and busy[3] <= at:
                attempt(busy[3])
            elif not busy and queue and queue[0][0] + flush <= at:
                close(queue[0][0] + flush)
            else:
                return

    for r in todo:
        until(r[0])
        queue.append(r)
        if len(queue) > most:
            out.append((queue.pop(0)[2], None, 0, "dropped", r[0]))
        if not busy and len(queue) >= size:
            close(r[0])
    until(clock)
    return out


@pytest.mark.parametrize(("size", "most", "files"), [(3, 5, 1), (3, 5, 6), (4, 4, 3), (1, 1, 2)])
def test_queue_against_a_loop(spark, size, most, files):
    rng = random.Random(size * 7 + most)
    rows = [(rng.randrange(6000) * S + i, f"k{rng.randrange(4)}", i, rng.choice([None, "x"])) for i in range(260)]
    d = streamed(spark, rows, "key string, id long, note string", files)
    out = ended(spark, stateful.ingest_queue(d, ["key"], size, "40 seconds", most, ["20 seconds", "80 seconds"], sent_unless_hashed, order=["id"]))
    got = sorted((r["key"], r["id"], r["batch"], r["attempts"], r["outcome"], int(r["at"].timestamp() * S + 0.5) - BASE) for r in out.collect())
    want = sorted((k, *f) for k in {r[1] for r in rows} for f in simulated([r for r in rows if r[1] == k], k, size, 40 * S, most, [20 * S, 80 * S], mark(rows)))
    assert [x[:5] for x in got] == [x[:5] for x in want] and all(abs(a[5] - b[5]) <= 1 for a, b in zip(got, want, strict=True))
    assert {"sent", "dead"} <= {x[4] for x in got}
    ids = [x[1] for x in got]
    assert len(ids) == len(set(ids))


def test_queue_keeps_its_bounds():
    q = stateful.Queue(2, 10, 3, [100], lambda *x: False)
    for t in range(20):
        q.push((t,))
        assert len(q.queue) <= 3 and len(q.sending) <= 2
    q.advance(10_000)
    assert sorted(r[0] for r, *_ in q.fates) == list(range(20)) and not q.queue and not q.sending
    with pytest.raises(ValueError):
        stateful.ingest_queue(None, [], 5, "1 second", 4, [], None)


# --- watch triggers ----------------------------------------------------------------------------------


def triggers(rows, gap, longest, clock):
    out, now = [], []

    def ends(some):
        end = some[-1][0] + gap
        return end if longest is None else min(end, some[0][0] + longest)

    def give(some):
        full = any(r[4] == "resync" for r in some)
        version = newest(r[5] for r in some)
        head = (some[0][0], ends(some), len(some), "full" if full else "delta", version)
        objects = {}
        for _, _, kind, name, op, v in some:
            if name:
                old = objects.get((kind, name), (None, None))[1]
                objects[kind, name] = (op, newest([old, v]))
        if full or not objects:
            return [(*head, None, None, None, None)]
        return [(*head, *k, *v) for k, v in sorted(objects.items())]

    def newest(versions):
        numbers = [int(v) for v in versions if v]
        return str(max(numbers)) if numbers else None

    for r in [r for r in rows if r[0] <= clock]:
        if now and r[0] >= ends(now):
            out += give(now)
            now = []
        now.append(r)
    if now and clock >= ends(now):
        out += give(now)
    return out


@pytest.mark.parametrize(("longest", "files"), [(None, 1), (60, 1), (60, 6), (7, 3)])
def test_watch_triggers_against_a_loop(spark, longest, files):
    rng = random.Random(longest or 0)
    rows = [(rng.randrange(4000) * S + i * 1000, "c" + str(i % 2), "pod", rng.choice(["a", "b", "c", "", None]), rng.choice(["upsert"] * 8 + ["delete"] * 4 + ["resync"]), rng.choice([str(i), "9", "", None])) for i in range(400)]
    d = streamed(spark, rows, "cluster string, kind string, object string, op string, version string", files)
    out = ended(spark, stateful.watch_triggers(d, ["cluster"], "12 seconds", f"{longest} seconds" if longest else None, order=[]))
    us = lambda t: int(t.timestamp() * S + 0.5) - BASE
    got = sorted((tuple(r)[:1] + (us(r["start"]), us(r["ends"])) + tuple(r)[3:] for r in out.collect()), key=str)
    want = sorted(((k, *t) for k in ("c0", "c1") for t in triggers([r for r in sorted(rows, key=lambda x: x[0]) if r[1] == k], 12 * S, longest and longest * S, mark(rows))), key=str)
    assert got == want


def test_newer_versions():
    assert [stateful.newer(*x) for x in (("9", "10"), ("10", "9"), ("", "3"), (None, None), ("b", "a"), ("9", "a"), (" 7 ", ""))] == ["10", "10", "3", None, "b", "a", "7"]
    assert zlib.crc32(b"k/1/1") % 3 > 0 or not sent_unless_hashed(("k",), 1, 1, [])
