"""Keyed state machines over streams: tail sampling, the ingest queue, the watch accumulator.

All take their rows in the order of the rows' own time: rows wait in their key's state until the watermark passes them, so results
don't depend on how rows are dealt to files and batches. Rows later than the watermark are dropped, as everywhere.
Rows lie in state by the thousand, a value for each batch of them, as a value a row costs more than the row's own work.
A machine says when it must be woken; a timer by event time does so. State is in RocksDB (see with_state()), and
what is done with a key is cleared.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

#: Where state lies; a stream's checkpoint keeps to the one that it began with.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The time of a row in microseconds, beside its own columns.
TIME = "row_micros"


def micros(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1_000_000)


#: Rows of a value in state, and rows that a machine takes in one step. They change speed and memory, never a result.
PACKED, STEP = 4096, 1 << 17


class Packed:
    """A list state of rows, many to a value."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.state = handle.getListState(name, "packed binary")

    def get(self) -> list[tuple]:
        return [r for (b,) in self.state.get() for r in pickle.loads(bytes(b))] if self.state.exists() else []

    def add(self, rows: list[tuple]) -> None:
        if rows:
            self.state.appendList([(pickle.dumps(rows[i : i + PACKED], 5),) for i in range(0, len(rows), PACKED)])

    def put(self, rows: list[tuple]) -> None:
        self.state.clear()
        self.add(rows)

    def clear(self) -> None:
        self.state.clear()


class InOrder(StatefulProcessor):
    """Rows of a key in the order of (time, order columns).

    Subclasses define begin(handle), step(key, rows, clock), which gives output rows, and due(), the microsecond at
    which step() must be called even without rows, or None. Rows come in as many steps as there are STEP of them; all
    rows before a step's clock have come with it.
    """

    def __init__(self, schema: StructType, ts: str, order: Sequence[str], out: Sequence[str]):
        self.state = StructType([StructField(TIME, LongType()), *[f for f in schema if f.name not in (ts, TIME)]])
        self.names = self.state.names
        self.at = {n: i for i, n in enumerate(self.names)}
        self.order = [0, *[self.at[c] for c in order]]
        self.out = list(out)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.schema = to_arrow_schema(self.state)
        self.inbox = handle.getListState("inbox", "first long, packed binary")
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, key: tuple, rows: list[tuple], clock: int) -> Iterable[tuple]:
        raise NotImplementedError

    def due(self) -> int | None:
        return None

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, packed = None, []
        for b in rows:
            if len(b):
                packed.append(self._packed(pa.Table.from_arrays([self._column(b[f.name], f.type) for f in self.schema], schema=self.schema)))
                first = min([packed[-1][0]] + ([] if first is None else [first]))
        if first is not None:
            self.inbox.appendList(packed)
            self._wake(first, timerValues)
        return iter(())

    @staticmethod
    def _column(x: pd.Series, kind: pa.DataType) -> pa.Array:
        if pa.types.is_map(kind):
            return pa.array([list(v.items()) if isinstance(v, dict) else v for v in x], kind)
        return pa.Array.from_pandas(x, type=kind)

    @staticmethod
    def _packed(rows: pa.Table) -> tuple[int, bytes]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as w:
            w.write_table(rows)
        return pc.min(rows.column(0)).as_py(), sink.getvalue().to_pybytes()

    def _tuples(self, rows: pa.Table) -> list[tuple]:
        values = [[v if v is None else dict(v) for v in c.to_pylist()] if pa.types.is_map(c.type) else c.to_pylist() for c in rows.columns]
        return list(zip(*values, strict=True))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [(r[0], bytes(r[1])) for r in self.inbox.get()] if self.inbox.exists() else []
        later = [x for x in waiting if x[0] > clock]
        ready = self.schema.empty_table()
        if len(later) < len(waiting):
            some = pa.concat_tables([pa.ipc.open_stream(b).read_all() for first, b in waiting if first <= clock])
            come = pc.less_equal(some.column(0), clock)
            ready, rest = some.filter(come), some.filter(pc.invert(come))
            if len(rest):
                later.append(self._packed(rest))
            del some, waiting
            ready = ready.take(pc.sort_indices(ready, sort_keys=[(self.names[i], "ascending") for i in self.order], null_placement="at_end"))
            self.inbox.clear()
            if later:
                self.inbox.put(later)
        for at in range(0, max(len(ready), 1), STEP):
            rows = self._tuples(ready.slice(at, STEP))
            out = list(self.step(tuple(key), rows, clock if at + STEP >= len(ready) else rows[-1][0] - 1))
            if out:
                yield pd.DataFrame(out, columns=self.out)
        if later:
            self._wake(min(x[0] for x in later), timerValues)
        if (due := self.due()) is not None:
            self._wake(due, timerValues)

    def _wake(self, at: int, timerValues: Any) -> None:
        self.handle.registerTimer(max(-(-at // 1000), timerValues.getCurrentWatermarkInMs()) + 1)

    def close(self) -> None:
        pass


def with_state(rows: DataFrame, keys: Sequence[str], machine: InOrder, out: str, ts: str, late: str) -> DataFrame:
    """The machine over a stream, a state a key. Sets the session's state store to RocksDB, which these states need."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = rows.withColumn(TIME, F.unix_micros(ts)).withWatermark(ts, late)
    return timed.groupBy(*keys).transformWithStateInPandas(machine, out, "append", "eventTime")


def _columns(schema: StructType, without: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name not in without)


# --- tail sampling -----------------------------------------------------------------------------------


class _TailSampler(InOrder):
    def __init__(self, schema: StructType, ts: str, order: Sequence[str], drop_if: str, wait: int, remember: int, most: int | None):
        names = [f.name for f in schema if f.name != ts]
        super().__init__(schema, ts, order, [*names, ts])
        self.drop_if, self.wait, self.remember, self.most, self.give = drop_if, wait, remember, most, names

    def begin(self, handle):
        self.pending = Packed(handle, "pending")
        self.trace = handle.getValueState("trace", "first long, last long, n long, decision string")

    def step(self, key, rows, clock):
        first, last, n, decision = self.trace.get() if self.trace.exists() else (None, None, 0, None)
        held: list[tuple] = []
        out: list[tuple] = []

        def decide(what: str) -> None:
            nonlocal decision, held
            if what == "sampled":
                out.extend(self.pending.get())
                out.extend(held)
            decision, held = what, []
            self.pending.clear()

        for r in rows:
            if decision and r[0] > last + self.remember:
                first, n, decision = None, 0, None  # forgotten: the id begins a new trace
            first = r[0] if first is None else first
            if decision is None and r[0] > first + self.wait:
                decide("sampled")
            last, n = r[0], n + 1
            if decision == "sampled":
                out.append(r)
            elif decision is None:
                held.append(r)
                if r[self.at[self.drop_if]] or (self.most and n > self.most):
                    decide("dropped")
        if decision is None and first is not None and clock > first + self.wait:
            decide("sampled")
        if decision and clock > last + self.remember:
            self.trace.clear()
        elif first is not None:
            if held:
                self.pending.add(held)
            self.trace.update((first, last, n, decision))
        when = self.names.index(TIME)
        return [(*[r[self.at[c]] for c in self.give], pd.Timestamp(r[when], unit="us")) for r in out]

    def due(self):
        if not self.trace.exists():
            return None
        first, last, _, decision = self.trace.get()
        return last + self.remember if decision else first + self.wait


def tail_sample(spans: DataFrame, drop_if: str, key: str = "trace_id", wait: str = "30 seconds", remember: str = "10 minutes", late: str = "2 minutes", ts: str = "ts", order: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """The spans of traces that are kept, each once.

    A trace is decided `wait` after its first span: dropped if one of its spans until then has drop_if true (or they
    are more than `most`), which is known at that span, else sampled. The decision holds for its later spans too, also
    those that come long after: they are given at once or dropped. It is forgotten `remember` after the trace's last
    span; a span after that begins a trace of its own. A null drop_if is false, a null key is one trace.
    Spans of undecided traces wait in state, of dropped ones none do.
    """
    machine = _TailSampler(spans.schema, ts, order, drop_if, micros(wait), micros(remember), most)
    names = [f.name for f in spans.schema if f.name != ts]
    out = _columns(StructType([*[spans.schema[n] for n in names], spans.schema[ts]]), ())
    return with_state(spans, [key], machine, out, ts, late).select(*spans.columns)


# --- ingest queue ------------------------------------------------------------------------------------


class Queue:
    """What the queue of one key does, on plain values: rows wait in `queue`, one batch at a time is being sent.

    A batch closes when `size` rows wait or its oldest row has waited for `flush`, unless another one is still being
    sent. A failed send is tried again after the back-offs, in turn; after the last one the batch is a dead letter. Meanwhile rows pile up;
    of more than `most` the oldest is dropped. fates: (row, batch, attempts, outcome, at) of the rows that are done.
    """

    def __init__(self, size: int, flush: int, most: int, backoffs: Sequence[int], send: Callable[[tuple, int, int, list], bool]):
        self.size, self.flush, self.most, self.backoffs, self.send = size, flush, most, list(backoffs), send
        self.load((), [], [], 0, 0, None)

    def load(self, key: tuple, queue: list, sending: list, batch: int, attempts: int, again: int | None) -> None:
        self.key, self.queue, self.sending, self.batch, self.attempts, self.again = key, queue, sending, batch, attempts, again
        self.fates: list[tuple] = []

    def due(self) -> int | None:
        if self.sending:
            return self.again
        return self.queue[0][0] + self.flush if self.queue else None

    def push(self, row: tuple) -> None:
        self.advance(row[0])
        self.queue.append(row)
        if len(self.queue) > self.most:
            self.fates.append((self.queue.pop(0), None, 0, "dropped", row[0]))
        if not self.sending and len(self.queue) >= self.size:
            self._close(row[0])

    def advance(self, clock: int) -> None:
        """All that falls due until clock, in order."""
        while (at := self.due()) is not None and at <= clock:
            if self.sending:
                self._try(at)
            else:
                self._close(at)

    def _close(self, at: int) -> None:
        self.sending, self.queue = self.queue[: self.size], self.queue[self.size :]
        self.batch, self.attempts = self.batch + 1, 0
        self._try(at)

    def _try(self, at: int) -> None:
        self.attempts += 1
        sent = self.send(self.key, self.batch, self.attempts, self.sending)
        if not sent and self.attempts <= len(self.backoffs):
            self.again = at + self.backoffs[self.attempts - 1]
            return
        self.fates += [(r, self.batch, self.attempts, "sent" if sent else "dead", at) for r in self.sending]
        self.sending, self.again = [], None
        if len(self.queue) >= self.size:
            self._close(at)


class _QueueProcessor(InOrder):
    def __init__(self, schema: StructType, ts: str, order: Sequence[str], queue: Queue):
        names = [f.name for f in schema if f.name != ts]
        super().__init__(schema, ts, order, [*names, ts, "batch", "attempts", "outcome", "at"])
        self.machine, self.give = queue, names

    def begin(self, handle):
        self.waiting = Packed(handle, "queue")
        self.batch = Packed(handle, "sending")
        self.meta = handle.getValueState("meta", "batch long, attempts long, again long")

    def step(self, key, rows, clock):
        m = self.machine
        m.load(key, self.waiting.get(), self.batch.get(), *(self.meta.get() if self.meta.exists() else (0, 0, None)))
        for r in rows:
            m.push(r)
        m.advance(clock)
        for state, now in ((self.waiting, m.queue), (self.batch, m.sending)):
            state.put(now)
        self.meta.update((m.batch, m.attempts, m.again))
        stamp = lambda t: pd.Timestamp(t, unit="us")
        return [(*[r[self.at[c]] for c in self.give], stamp(r[0]), b, n, outcome, stamp(at)) for r, b, n, outcome, at in m.fates]

    def due(self):
        return self.machine.due()


def ingest_queue(rows: DataFrame, keys: Sequence[str], size: int, flush: str, most: int, backoffs: Sequence[str], send: Callable[[tuple, int, int, list], bool], late: str = "2 minutes", ts: str = "ts", order: Sequence[str] = ()) -> DataFrame:
    """Each row once with its fate: batch (null if dropped), attempts, outcome sent, dead or dropped, and at.

    Rows of a key are queued in the order of their time, see Queue. send(key, batch, attempt, rows) delivers a batch
    and says whether it could; it must bear to be called again with the same arguments after a failure of the job.
    State is bounded by `most` and `size` rows a key, beside those that the watermark has not passed. `most` is not less than `size`.
    """
    if not 1 <= size <= most:
        raise ValueError("a queue holds at least a batch, and a batch a row")
    queue = Queue(size, micros(flush), most, [micros(b) for b in backoffs], send)
    machine = _QueueProcessor(rows.schema, ts, order, queue)
    names = [f.name for f in rows.schema if f.name != ts]
    out = _columns(StructType([*[rows.schema[n] for n in names], rows.schema[ts]]), ()) + ", batch long, attempts long, outcome string, at timestamp"
    return with_state(rows, keys, machine, out, ts, late).select(*rows.columns, "batch", "attempts", "outcome", "at")


# --- watch accumulator -------------------------------------------------------------------------------


def newer(current: str | None, candidate: str | None) -> str | None:
    """The newer resource version: by number where both are numbers, else by text; an empty one is none."""
    current, candidate = (current or "").strip(), (candidate or "").strip()
    if not current or not candidate:
        return candidate or current or None
    if current.isdecimal() and candidate.isdecimal():
        return candidate if int(candidate) > int(current) else current
    return max(current, candidate)


class _Watch(InOrder):
    OUT = ("start", "ends", "n", "sync", "version", "kind", "object", "op", "object_version")

    def __init__(self, schema: StructType, ts: str, order: Sequence[str], keys: Sequence[str], gap: int, longest: int | None):
        super().__init__(schema, ts, order, [*keys, *self.OUT])
        self.gap, self.longest = gap, longest

    def begin(self, handle):
        self.objects = Packed(handle, "objects")
        self.trigger = handle.getValueState("trigger", "first long, last long, n long, full boolean, version string")

    def _ends(self, first: int, last: int) -> int:
        return last + self.gap if self.longest is None else min(last + self.gap, first + self.longest)

    def step(self, key, rows, clock):
        now = self.trigger.get() if self.trigger.exists() else None
        objects = {r[:2]: r[2:] for r in self.objects.get()}
        out: list[tuple] = []

        def give(t: tuple) -> None:
            first, last, n, full, version = t
            stamps = (pd.Timestamp(first, unit="us"), pd.Timestamp(self._ends(first, last), unit="us"), n, "full" if full else "delta", version)
            if full or not objects:
                out.append((*key, *stamps, None, None, None, None))
            else:
                out.extend((*key, *stamps, *k, *v) for k, v in sorted(objects.items()))
            objects.clear()

        for r in rows:
            t, kind, name, op, version = (r[self.at[c]] for c in (TIME, "kind", "object", "op", "version"))
            if now and t >= self._ends(now[0], now[1]):
                give(now)
                now = None
            first, _, n, full, known = now or (t, t, 0, False, None)
            if op == "resync":
                full = True
                objects.clear()
            elif not full and name:
                place = (kind, name)
                objects[place] = (op, newer(objects.get(place, (None, None))[1], version))
            now = (first, t, n + 1, full, newer(known, version))
        if now and clock >= self._ends(now[0], now[1]):
            give(now)
            now = None
        self.objects.put([(*k, *v) for k, v in objects.items()])
        if now:
            self.trigger.update(now)
        else:
            self.trigger.clear()
        return out

    def due(self):
        return self._ends(*self.trigger.get()[:2]) if self.trigger.exists() else None


def watch_triggers(changes: DataFrame, keys: Sequence[str], gap: str = "2 seconds", longest: str | None = "30 seconds", late: str = "2 minutes", ts: str = "ts", order: Sequence[str] = ()) -> DataFrame:
    """(keys, start, ends, n, sync, version, kind, object, op, object_version): what each trigger tells to synchronise.

    changes: keys, ts, kind, object, op (upsert, delete or resync), version (text). Changes that follow each other within `gap`
    are one trigger, which ends `gap` after the last one, or `longest` after the first, whatever goes on. A delta trigger has a row
    for each object with its last operation, deletes being tombstones, and its newest version; objects without a name are counted only. A trigger
    with a resync is one full row without objects: what came before is forgotten and what follows in it is contained.
    """
    machine = _Watch(changes.schema, ts, order, keys, micros(gap), micros(longest) if longest else None)
    types = dict(changes.dtypes)
    out = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", start timestamp, ends timestamp, n long, sync string, version string, kind string, object string, op string, object_version string"
    return with_state(changes, keys, machine, out, ts, late)
