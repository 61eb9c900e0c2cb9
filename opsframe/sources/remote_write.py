"""Samples in the remote-write wire format: encoder, decoder with a cap, and a data source with commit and abort.

A body is a snappy block of a WriteRequest message: series of labels and samples, the metric's name being the label
`__name__`. The source "remote_write" keeps files of bodies; a commit names the files of the tasks that succeeded, and
only files that a commit names are read, so a task that runs twice doubles nothing.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "name string, labels map<string,string>, t long, value double"
#: Bytes of a message before compression: what the writer aims at, and what the decoder takes at most. Fixed values.
TARGET, MOST = 6 << 20, 16 << 20
#: Samples of one body at most, whatever their size.
SAMPLES = 1 << 17
#: Samples of a series below which they are encoded one by one.
FEW = 32
_DOUBLE = struct.Struct("<d").unpack_from
_KINDS = pa.schema([("name", pa.string()), ("labels", pa.map_(pa.string(), pa.string())), ("t", pa.int64()), ("value", pa.float64())])


class WireError(ValueError):
    """A body that can't be taken: too large, cut off, or not of the format."""


# --- encoding ----------------------------------------------------------------------------------------


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def encode_samples(t: np.ndarray, value: np.ndarray) -> bytes:
    """Sample messages (value: double 1, time in milliseconds: varint 2) as fields 2 of their series, all at once; a few one by one, as arrays cost more than they."""
    if len(t) < FEW:
        inner = [b"\x09" + struct.pack("<d", v) + (b"\x10" + varint(u) if u else b"") for u, v in zip(t.tolist(), value.tolist(), strict=True)]
        return b"".join(b"\x12" + bytes([len(x)]) + x for x in inner)
    u = t.astype(np.int64).view(np.uint64)
    size = np.ones(len(u), dtype=np.int64)
    for k in range(1, 10):
        size += u >= np.uint64(1 << 7 * k)
    inner = 9 + np.where(u > 0, 1 + size, 0)  # a time of zero is left out, as defaults are
    out = np.empty(int((inner + 2).sum()), dtype=np.uint8)
    at = np.cumsum(inner + 2) - (inner + 2)
    out[at], out[at + 1], out[at + 2] = 0x12, inner, 0x09
    raw = np.ascontiguousarray(value, dtype="<f8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        out[at + 3 + k] = raw[:, k]
    some = np.flatnonzero(u > 0)
    out[at[some] + 11] = 0x10
    for k in range(10):
        here = some[size[some] > k]
        more = np.where(size[here] > k + 1, 0x80, 0)
        out[at[here] + 12 + k] = (u[here] >> np.uint64(7 * k) & np.uint64(0x7F)).astype(np.int64) | more
    return out.tobytes()


def encode_series(name: str, labels: dict[str, str], t: np.ndarray, value: np.ndarray) -> bytes:
    own = sorted({**labels, "__name__": name}.items())
    text = lambda k, v: _field(k, v.encode()) if v else b""
    return b"".join(_field(1, text(1, k) + text(2, v)) for k, v in own) + encode_samples(t, value)


def pack(message: bytes) -> bytes:
    return pa.Codec("snappy").compress(message, asbytes=True)


def bodies(batch: pa.RecordBatch, target: int = TARGET) -> Iterator[tuple[bytes, int]]:
    """(body, samples) of the batch's rows, series by series; a body's message is closed before it would exceed target, rows without a time or value are no samples."""
    batch = batch.filter(pc.and_(pc.is_valid(batch.column("t")), pc.is_valid(batch.column("value"))))
    names, labels = batch.column("name").to_pylist(), batch.column("labels").to_pylist()
    by: dict[tuple, list[int]] = {}
    for i, (n, lab) in enumerate(zip(names, labels, strict=True)):
        by.setdefault((n or "", tuple(sorted((k, v or "") for k, v in lab or []))), []).append(i)
    t, value = batch.column("t").to_numpy(zero_copy_only=False), batch.column("value").to_numpy(zero_copy_only=False)
    held, size, count = [], 0, 0
    step = max(1, min(SAMPLES, target // 32))
    for (name, lab), rows in by.items():
        for lo in range(0, len(rows), step):
            some = np.array(rows[lo : lo + step])
            one = _field(1, encode_series(name, dict(lab), t[some], value[some]))
            if held and size + len(one) > target:
                yield pack(b"".join(held)), count
                held, size, count = [], 0, 0
            held.append(one)
            size, count = size + len(one), count + len(some)
    if held:
        yield pack(b"".join(held)), count


# --- decoding ----------------------------------------------------------------------------------------


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise WireError("a number is cut off or too long")
        b = raw[at]
        out |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return out, at


def _fields(raw: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(number, kind, value or start, end) of a message's fields."""
    while at < end:
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            v, at = _varint(raw, at)
            yield tag >> 3, kind, v, at
            continue
        n, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(raw, at) if kind == 2 else (-1, at)
        if n < 0 or at + n > end:
            raise WireError("a field is cut off or of an unknown kind")
        yield tag >> 3, kind, at, at + n
        at += n


def unpack(body: bytes, most: int = MOST) -> bytes:
    """The message of a body. Its size stands before the data, so one above `most` is refused before anything is inflated."""
    if len(body) > most:
        raise WireError(f"{len(body)} bytes of a body are more than {most}")
    size, _ = _varint(body, 0)
    if size > most:
        raise WireError(f"{size} bytes of a message are more than {most}")
    try:
        return pa.Codec("snappy").decompress(body, decompressed_size=size, asbytes=True)
    except (pa.ArrowException, OSError) as e:
        raise WireError("not a snappy block") from e


def decode(body: bytes, most: int = MOST) -> list[tuple[str, dict[str, str], int, float]]:
    """(name, labels, t, value) of a body's samples. Unknown fields are passed over."""
    raw, out = unpack(body, most), []
    for number, kind, lo, hi in _fields(raw, 0, len(raw)):
        if (number, kind) != (1, 2):
            continue
        labels, samples = {}, []
        for n, k, a, b in _fields(raw, lo, hi):
            if (n, k) == (1, 2):
                text = {m: raw[x:y] for m, kk, x, y in _fields(raw, a, b) if kk == 2}
                try:
                    labels[text.get(1, b"").decode()] = text.get(2, b"").decode()
                except UnicodeDecodeError as e:
                    raise WireError("a label is no text") from e
            elif (n, k) == (2, 2):
                t, v = 0, 0.0
                # as writers put it: the value, then the time, and no more
                if b - a >= 9 and raw[a] == 0x09:
                    v = _DOUBLE(raw, a + 1)[0]
                    if b - a == 9:
                        samples.append((t, v))
                        continue
                    if raw[a + 9] == 0x10:
                        t, end = _varint(raw, a + 10)
                        if end == b:
                            samples.append((t - (1 << 64) if t >> 63 else t, v))
                            continue
                    t, v = 0, 0.0
                for m, kk, x, _ in _fields(raw, a, b):
                    if (m, kk) == (1, 1):
                        v = struct.unpack_from("<d", raw, x)[0]
                    elif (m, kk) == (2, 0):
                        t = x - (1 << 64) if x >> 63 else x
                samples.append((t, v))
        name = labels.pop("__name__", "")
        out += [(name, labels, t, v) for t, v in samples]
    return out


def decoded(rows: DataFrame, column: str = "body", most: int = MOST) -> DataFrame:
    """(SCHEMA, problem) of the bodies in a binary column; one that can't be taken is a row with only the problem. A null body has no samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column(0).to_pylist():
                try:
                    got, problem = ([(*r, None) for r in decode(body, most)] if body is not None else []), None
                except WireError as e:
                    got, problem = [], str(e)
                if problem:
                    got = [(None, None, None, None, problem)]
                if got:
                    cols = list(zip(*got, strict=True))
                    labels = [None if x is None else list(x.items()) for x in cols[1]]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(labels, _KINDS.field("labels").type), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.string())], ["name", "labels", "t", "value", "problem"])

    return rows.select(column).mapInArrow(run, f"{SCHEMA}, problem string")


# --- the data source ---------------------------------------------------------------------------------


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    bodies: int
    samples: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, target: int):
        self.path, self.target = path, target

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = _store(self.path)
        file, out, n, samples = f"data/{uuid.uuid4().hex}.rw", None, 0, 0
        for b in iterator:
            for body, count in bodies(b, self.target):
                if out is None:
                    store.create_dir(f"{folder}/data", recursive=True)
                    out = store.open_output_stream(f"{folder}/{file}")
                out.write(struct.pack("<I", len(body)) + body)
                n, samples = n + 1, samples + count
        if out is not None:
            out.close()
        return _Written(file if out is not None else None, n, samples)

    def commit(self, messages: list) -> None:
        store, folder = _store(self.path)
        done = [m for m in messages if m is not None and m.file]
        store.create_dir(f"{folder}/commits", recursive=True)
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{folder}/commits/.{name}") as f:
            f.write(json.dumps({"files": [m.file for m in done], "bodies": sum(m.bodies for m in done), "samples": sum(m.samples for m in done)}).encode())
        store.move(f"{folder}/commits/.{name}", f"{folder}/commits/{name}.json")  # a commit is there whole or not at all

    def abort(self, messages: list) -> None:
        store, folder = _store(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{folder}/{m.file}")


@dataclass
class _File(InputPartition):
    file: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[_File]:
        store, folder = _store(self.path)
        found = [x.path for x in store.get_file_info(fs.FileSelector(f"{folder}/commits", allow_not_found=True)) if x.path.endswith(".json")]
        files = []
        for c in sorted(found):
            with store.open_input_stream(c) as f:
                files += json.loads(f.read())["files"]
        return [_File(x) for x in files]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition is None or not isinstance(partition, _File):
            return
        store, folder = _store(self.path)
        with store.open_input_stream(f"{folder}/{partition.file}") as f:
            while head := f.read(4):
                rows = decode(f.read(struct.unpack("<I", head)[0]), self.most)
                for lo in range(0, len(rows), 10_000):
                    name, labels, t, value = zip(*rows[lo : lo + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array([list(x.items()) for x in labels], _KINDS.field("labels").type), pa.array(t, pa.int64()), pa.array(value, pa.float64())], schema=_KINDS)


class RemoteWrite(DataSource):
    """format("remote_write") with options path, target (bytes of a message) and most (bytes that are taken)."""

    @classmethod
    def name(cls) -> str:
        return "remote_write"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("most", MOST)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("samples are appended, never overwritten")
        if [f.name for f in schema] != [f.name for f in _KINDS]:
            raise ValueError(f"columns are {SCHEMA}")
        return _Writer(self.options["path"], int(self.options.get("target", TARGET)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RemoteWrite)
