"""Best-fit packing of documents into sequences by large-item matching.

Pieces above a third of the capacity go at most two to a bin: the longest piece left is matched
with the longest that still fits beside it. Shorter pieces, longest first, go to the tightest gap.

The plan needs only how many pieces there are of each length, at most `capacity` numbers, so it is
made once, for the whole corpus, on the driver. It maps ranges of ranks among the pieces of one
length to ranges of bins. Executors then give each piece its rank and look its place up. No task
holds more than a bucket of pieces, and the packing is the same for any number of partitions.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import worker_bpe
from .common import few_files, map_to_table, materialize, small_batches

if TYPE_CHECKING:
    import pyarrow as pa

    from .common import ArrowMap

PIECES = "doc_id long, piece int, start long, length long, ids binary"


def _encoder(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, digests: bool) -> tuple[DataFrame, ArrowMap]:
    small_batches(docs.sparkSession)
    with open(tokenizer, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        bpe = worker_bpe(spec.value)
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(bpe.encode(text or ""), np.uint32(end_id)).astype("<u4")
                at, first = 0, len(ids) % capacity or capacity
                for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                    raw = ids[at:end].tobytes()
                    out.append((doc, k, at, end - at, zlib.crc32(raw) if digests else raw))
                    at = end
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64() if digests else pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32" if digests else "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece: doc_id, piece (from 0), start, length, ids (little-endian uint32).

    A document is its ids, then end_id; null text counts as empty, so it is one piece of one id.
    Only documents above the capacity are cut; the first piece takes the remainder. Repeated rows
    and null ids are packed like any other row. Other columns are ignored.
    """
    rows, run = _encoder(docs, tokenizer, capacity, end_id, digests=False)
    return rows.mapInArrow(run, PIECES)


def encode_digests(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, rows: int | None = None) -> DataFrame:
    """encode_pieces() with ids_crc32, the unsigned crc32 of a piece's ids, in place of ids, as a table in the shared folder."""
    some, run = _encoder(docs, tokenizer, capacity, end_id, digests=True)
    return map_to_table(some, run, PIECES.replace("ids binary", "ids_crc32 long"), "pieces", rows, owner="bpe")


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, end rank, first bin, pieces a bin, offset): where the pieces of each length go."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        if not 0 < n <= capacity:
            raise ValueError(f"length {n} is outside 1..{capacity}")
        left[n] = c
    total = left.copy()
    rows: list[tuple[int, ...]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> ranges of bins
    bins = 0

    def put(n: int, count: int, first: int, each: int, offset: int) -> None:
        rank = int(total[n] - left[n])
        rows.append((n, rank, rank + count, first, each, offset))
        left[n] -= count

    third = capacity // 3
    for a in range(capacity, third, -1):
        while left[a]:
            top = min(a, capacity - a)
            fits = np.flatnonzero(left[third + 1 : top + 1]) + third + 1 if top > third else np.empty(0, dtype=int)
            if len(fits) and fits[-1] == a and left[a] == 1:
                fits = fits[:-1]
            if not len(fits):
                m = int(left[a])
                put(a, m, bins, 1, 0)
                gaps[capacity - a].append((bins, bins + m))
            else:
                b = int(fits[-1])
                m = int(left[a] // 2 if a == b else min(left[a], left[b]))
                put(a, m, bins, 1, 0)
                put(b, m, bins, 1, a)
                gaps[capacity - a - b].append((bins, bins + m))
            bins += m
    for s in range(third, 0, -1):
        while left[s]:
            g = min((g for g, free in gaps.items() if g >= s and free), default=None)
            if g is None:
                g = capacity
                need = -(-int(left[s]) // (capacity // s))
                gaps[g].append((bins, bins + need))
                bins += need
            lo, hi = gaps[g].pop()
            each = min(g // s, int(left[s]))
            full = min(hi - lo, int(left[s]) // each)
            put(s, full * each, lo, each, capacity - g)
            gaps[g - each * s].append((lo, lo + full))
            if lo + full < hi:
                gaps[g].append((lo + full, hi))
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = 2048, rows: int | None = None, stored: bool = False) -> DataFrame:
    """pieces (doc_id, piece, length and any other columns) with sequence_id and offset added.

    rows: about how many there are, for the number of files. stored: pieces is a table already; else it is written to one, as it is read several times.

    Sequences hold at most `capacity`, offsets are gapless from 0. Equal lengths are ranked by
    (bucket, doc_id, piece). Lengths outside 1..capacity raise. No piece gives no sequence.
    """
    spark = pieces.sparkSession
    keys = [c for c in ("doc_id", "piece") if c in pieces.columns]
    tag = "__bucket"
    # a hot length is dealt over many buckets
    pieces = pieces if stored else materialize(pieces, "pieces", rows)
    n = pieces.count()
    pieces = pieces.withColumn(tag, F.pmod(F.xxhash64(*keys), F.lit(max(64, n >> 14))))
    per = pieces.groupBy("length", tag).agg(F.count(F.lit(1)).alias("__n"))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy(tag).rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("length", tag, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = pieces.withColumn("__rank", F.row_number().over(Window.partitionBy("length", tag).orderBy(*keys)))
    ranked = ranked.join(starts, ["length", tag])

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = places.value
        key = p[:, 0] << 44 | p[:, 1]
        r = p[np.searchsorted(key, length.to_numpy() << 44 | rank.to_numpy(), side="right") - 1]
        k = rank.to_numpy() - r[:, 1]
        return pd.DataFrame({"sequence_id": r[:, 3] + k // r[:, 4], "offset": r[:, 5] + k % r[:, 4] * r[:, 0]})

    at = place(F.col("length"), F.col("__before") + F.col("__rank") - 1)
    return few_files(ranked.withColumn("__at", at).select(*[c for c in pieces.columns if c != tag], "__at.sequence_id", "__at.offset"), n)
