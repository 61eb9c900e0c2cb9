"""WARC records in seekable Zstandard bundles.

A bundle is a row of independent frames of whole records and, as its last frame, a seek table in the
seekable format (a skippable frame: the compressed and the plain size of each frame, then a footer).
The index maps a record to its bundle, frame and offset in the plain frame, so that one record is
read by two short reads and one frame's decompression.

Executors write bundles to the shared folder under names that no other attempt uses; the index, which
Spark commits, names those of the attempts that count. So a lost executor or a task that runs twice
leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_files, fresh_path, materialize, small_batches

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Plain bytes of a frame and compressed bytes of a bundle at which the next one begins.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20

#: Digests that are broadcast at most, 48 bytes each.
BROADCAST_ROWS = 1 << 19

INDEX = "page_id long, record_id string, bundle string, frame int, frame_at long, frame_bytes int, offset int, length int"
RECORDS = "page_id long, record_id string, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload binary"


def store(uri: str):
    """(file system, path): by the URI's scheme, so that it works for any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, first: int | None) -> tuple[str, bytes]:
    """(record id, bytes). first: the page that this one repeats; a revisit has headers only."""
    rid, target = f"<urn:opsframe:page:{page}>", "".join((url or "").split())
    kind = "response" if first is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"X-Payload-Length: {len(payload)}",
    ]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:opsframe:page:{first}>"]
    body = payload if first is None else b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return rid, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(h["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("damaged record")
    return h | {"body": rest[:n]}


def _page(rid: str | None) -> int | None:
    page = rid[:-1].rpartition(":")[2] if rid else "None"
    return None if page == "None" else int(page)


class Bundle:
    """Writes one bundle; close() returns the index rows, with the bundle's name."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.frame_bytes, self.name = frame_bytes, f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
        self.fs, path = store(self.name)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(path, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.plain, self.table, self.rows, self.waiting, self.written = bytearray(), [], [], [], 0

    def add(self, page: int | None, rid: str, raw: bytes) -> None:
        self.waiting.append((page, rid, len(self.plain), len(raw)))
        self.plain += raw
        if len(self.plain) >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        frame = self.zstd.compress(bytes(self.plain))
        self.rows += [(p, r, self.name, len(self.table), self.written, len(frame), at, n) for p, r, at, n in self.waiting]
        self.out.write(frame)
        self.table.append((len(frame), len(self.plain)))
        self.written += len(frame)
        self.plain, self.waiting = bytearray(), []

    def close(self) -> list[tuple]:
        self.flush()
        seek = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(seek)) + seek)
        self.out.close()
        return self.rows


class BundleReader:
    """Random access by the seek table; keeps the last frame."""

    def __init__(self, name: str):
        import zstandard

        fs, path = store(name)
        self.file, self.zstd, self.last = fs.open_input_file(path), zstandard.ZstdDecompressor(), (-1, b"")
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{name} has no seek table")
        raw = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.sizes, self.starts, at = [], [], 0
        for k in range(n):
            c, d = struct.unpack_from("<II", raw, 8 * k)
            self.sizes.append((c, d))
            self.starts.append(at)
            at += c

    def read(self, frame: int, offset: int, length: int) -> bytes:
        if self.last[0] != frame:
            packed, plain = self.sizes[frame]
            self.last = frame, self.zstd.decompress(self.file.read_at(packed, self.starts[frame]), max_output_size=plain)
        return self.last[1][offset : offset + length]

    def close(self) -> None:
        self.file.close()


def write_archives(pages: DataFrame, folder: str | None = None, min_payload: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) and return the index, see INDEX.

    The payload is the html in UTF-8, null html is empty. Of equal payloads of at least min_payload
    bytes the smallest page_id is the response, the others revisit it; rows that repeat that very
    page_id are responses too, and so are rows with a null page_id. Other columns are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or fresh_path(spark, "warc")
    payload: Column = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    total = pages.count()
    seen = rows.where(F.length("payload") >= min_payload).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    seen = materialize(seen.where("n > 1"), "digests", total)
    # payloads stay where they are if the digests that repeat can be broadcast; if not, those that repeat most are, and only the others' payloads move
    if seen.count() > BROADCAST_ROWS:
        hot = total // BROADCAST_ROWS + 1
        rows = rows.join(F.broadcast(seen.where(F.col("n") > hot).select("sha", F.col("first").alias("of_hot"))), "sha", "left")
        few = rows.where("of_hot is null").join(seen.where(F.col("n") <= hot).select("sha", "first"), "sha", "left").drop("of_hot")
        rows = few.unionByName(rows.where("of_hot is not null").withColumnRenamed("of_hot", "first"))
    else:
        rows = rows.join(F.broadcast(seen.select("sha", "first")), "sha", "left")
    first = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    rows = rows.select("page_id", "url", "payload", first.alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [x.split()[0] for x in INDEX.split(", ")]
        made = lambda x: pd.DataFrame(x, columns=cols).astype({"page_id": "Int64"})
        bundle = None
        for b in batches:
            for page, url, body, again in zip(b["page_id"], b["url"], b["payload"], b["first"], strict=True):
                page = None if pd.isna(page) else int(page)
                bundle = bundle or Bundle(folder, frame_bytes)
                bundle.add(page, *record(page, url, bytes(body), None if pd.isna(again) else int(again)))
                if bundle.written >= bundle_bytes:
                    yield made(bundle.close())
                    bundle = None
        if bundle:
            yield made(bundle.close())

    return materialize(rows.mapInPandas(run, INDEX), "index", total)


def read_archives(index: DataFrame) -> DataFrame:
    """Read every record of the index back, see RECORDS; refers_to and payload_* come from the records themselves."""
    small_batches(index.sparkSession)
    # a number of its own: the index is small, so that its bytes say nothing of the work
    bundles = max(1, index.select("bundle").distinct().count())
    rows = index.repartition(bundles, "bundle").sortWithinPartitions("bundle", "frame", "offset")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, reader = None, None
        for b in batches:
            out = []
            for bundle, frame, offset, length in zip(b["bundle"], b["frame"], b["offset"], b["length"], strict=True):
                if bundle != name:
                    if reader:
                        reader.close()
                    name, reader = bundle, BundleReader(bundle)
                r = parse(reader.read(frame, offset, length))
                digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
                if r["WARC-Type"] == "response" and digest_of(r["body"]) != digest:
                    raise ValueError(f"damaged payload of {r['WARC-Record-ID']}")
                out.append((_page(r["WARC-Record-ID"]), r["WARC-Record-ID"], r["WARC-Type"], _page(r.get("WARC-Refers-To")), int(r["X-Payload-Length"]), digest, r["WARC-Target-URI"], r["body"]))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in RECORDS.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
        if reader:
            reader.close()

    return few_files(rows.mapInPandas(run, RECORDS), index.count())
