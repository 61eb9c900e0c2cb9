"""Periodic runs of words: a scan of every lag.

A text's words become ids in an array. For each lag q up to n / LEAST_EXPONENT the array is compared with itself
shifted by q; a stretch of true comparisons is a stretch of words with period q. The words of many texts lie in
one array, longest text first, so a lag is one comparison for all texts that are long enough. Between texts is
an id of its own: what is true across it is shorter than q and never counts.

Texts of more than LONG bytes are dealt out: the pairs (text, range of lags) are rows, of at most UNIT comparisons
each, that go to tasks by text and range, and the stretches found meet again by text. Of stretches with one start
and end the least period stays: it divides the others, as they are four periods long.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

if TYPE_CHECKING:
    import pyarrow as pa

#: Periods that a run holds at least, and its least length in words.
LEAST_EXPONENT, LEAST_LENGTH = 4, 6
#: Bytes of a text from which its lags are dealt out, and comparisons of one range of lags.
LONG, UNIT = 1 << 18, 1 << 31
#: What lies between words: fixed value.
BLANK = r"[\x20\x09-\x0D]+"
RUN = "struct<start:long,length:long,period:long>"


def stretches(ids: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths in words) of the stretches with period q that are long enough."""
    least = max(LEAST_LENGTH, LEAST_EXPONENT * q) - q
    at = np.flatnonzero(ids[q:] == ids[:-q])
    if len(at) < least or not (at[least - 1 :] - at[: len(at) - least + 1] == least - 1).any():
        return at[:0], at[:0]
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    first = np.concatenate([[0], cut])
    size = np.diff(np.concatenate([first, [len(at)]]))
    long = size >= least
    return at[first[long]], size[long] + q


def least_periods(found: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) by start and period, of equal stretches the one with the least period."""
    best: dict[tuple[int, int], int] = {}
    for s, n, q in found:
        best[s, n] = min(q, best.get((s, n), q))
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def scan(texts: Sequence[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each array of ids, none negative, its runs."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], dtype=np.int64)
    if not len(sizes) or sizes[0] < LEAST_LENGTH:
        return found
    ends = np.cumsum(sizes + 1)  # behind the id that ends the text
    starts = ends - sizes - 1
    ids = np.empty(ends[-1], dtype=np.int32)
    for k, i in enumerate(order):
        ids[starts[k] : ends[k] - 1] = texts[i]
        ids[ends[k] - 1] = -1 - k
    for q in range(1, int(sizes[0]) // LEAST_EXPONENT + 1):
        enough = int(np.searchsorted(-sizes, -max(LEAST_LENGTH, LEAST_EXPONENT * q), side="right"))
        if not enough:
            break
        at, length = stretches(ids[: ends[enough - 1]], q)
        for s, n in zip(at.tolist(), length.tolist(), strict=True):
            k = int(np.searchsorted(starts, s, side="right")) - 1
            found[order[k]].append((s - int(starts[k]), n, q))
    return [least_periods(f) for f in found]


def word_ids(texts: Sequence[str | None]) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Words, split at white space of ASCII, and for each text its words' ids."""
    import pandas as pd

    words = [t.encode().split() if t else [] for t in texts]
    flat = np.array([w for ws in words for w in ws], dtype=object)
    ids = pd.factorize(flat)[0].astype(np.int32) if len(flat) else np.zeros(0, dtype=np.int32)
    return words, np.split(ids, np.cumsum([len(ws) for ws in words])[:-1]) if words else []


def collapse(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> str:
    """The words that no run contains after its first period."""
    keep = np.ones(len(words), dtype=bool)
    for s, n, q in runs:
        keep[s + q : s + n] = False
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode()


def _rows(found: Sequence[Sequence[tuple[int, int, int]]]) -> pa.Array:
    """The column of runs; its fields have an order, which inference would not keep."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.array([[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found], kind)


def _result(b: pa.RecordBatch, words: list[list[bytes]], runs: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [b.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), _rows(runs), pa.array([collapse(w, r) for w, r in zip(words, runs, strict=True)], pa.string())],
        ["doc_id", "n_words", "runs", "collapsed"],
    )


def lag_ranges(n: int, unit: int) -> Iterator[tuple[int, int]]:
    """[lo, hi) that cover the lags of n words, of at most `unit` comparisons, one lag at least."""
    lo, last = 1, n // LEAST_EXPONENT
    while lo <= last:
        hi = min(last + 1, lo + max(1, unit // n))
        yield lo, hi
        lo = hi


def periodic_runs(docs: DataFrame, text_col: str = "text", long: int = LONG, unit: int = UNIT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and the collapsed text of each row.

    A run is a maximal stretch of at least LEAST_LENGTH words and LEAST_EXPONENT times its least period. The
    collapsed text has the words that no run contains after its first period, joined by one space. Null and empty texts
    have no words and no runs. Repeated rows stay, null doc_ids too; rows of one doc_id are judged each by its own text;
    other columns are ignored. Words differ by their bytes, case included. No row, no result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    out = f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string"
    large = F.coalesce(F.octet_length("text"), F.lit(0)) > long

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, ids = word_ids(b.column("text").to_pylist())
            yield _result(b, words, scan(ids))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = word_ids([text])[1][0]
                for lo, hi in lag_ranges(len(ids), unit):
                    yield pa.RecordBatch.from_pydict({"key": [key], "lo": [lo], "hi": [hi], "ids": [ids.tobytes()]})

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for b in batches:
            for key, lo, hi, raw in zip(*[b.column(c).to_pylist() for c in ("key", "lo", "hi", "ids")], strict=True):
                ids, found = np.frombuffer(raw, dtype=np.int32), []
                for q in range(lo, hi):
                    at, length = stretches(ids, q)
                    found += [(s, n, q) for s, n in zip(at.tolist(), length.tolist(), strict=True)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), _rows([found])], ["key", "found"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = word_ids(b.column("text").to_pylist())[0]
            found = [[(r["start"], r["length"], r["period"]) for some in f or [] for r in some] for f in b.column("found").to_pylist()]
            yield _result(b, words, [least_periods(f) for f in found])

    # equal texts have equal runs: the key is the text's digest, not the row
    longs = rows.where(large).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    dealt = longs.select("key", "text").dropDuplicates(["key"]).mapInArrow(deal, "key string, lo long, hi long, ids binary")
    found = dealt.repartition(_partitions(docs), "key", "lo").mapInArrow(look, f"key string, found array<{RUN}>")
    per = longs.join(found.groupBy("key").agg(F.collect_list("found").alias("found")), "key", "left").drop("key")
    return rows.where(~large).mapInArrow(small, out).unionByName(per.mapInArrow(meet, out))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first one of equals; null without runs."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(more(best, r), r).otherwise(best))


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which, for every tenth hash of doc_id, the words from a place on repeat with a period, both drawn by the hash."""

    def let(value: Column, f) -> Column:
        return F.get(F.transform(F.array(value), f), F.lit(0))

    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    words = F.array_remove(F.split(text, BLANK), "")
    # a text without words has nothing to plant: the sequence must not run down
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(words, repeat)).otherwise(text)


ORACLE = """
WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(doc_id::VARCHAR, '.'),
 lambda x: list_prepend(ascii(x)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) AS h FROM documents),
s AS (SELECT doc_id, w, len(w) AS n, h, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a FROM c),
t AS (SELECT doc_id, w, n, CASE WHEN h % 10 = 0 AND n > 0 THEN a END AS a, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM s),
x AS MATERIALIZED (SELECT doc_id, i, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word, n FROM (SELECT *, unnest(range(0, n)) AS i FROM t)),
l AS (SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS q FROM t WHERE n >= 6),
k AS (SELECT doc_id, q, unnest(range(0, n // q)) AS k FROM l),
e AS (SELECT k.doc_id, q, k FROM k JOIN x b ON b.doc_id = k.doc_id AND b.i = k * q JOIN x d ON d.doc_id = k.doc_id AND d.i = (k + 1) * q WHERE b.word = d.word),
m AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, q, k - lag(k, 2) OVER (PARTITION BY doc_id, q ORDER BY k) AS d FROM e) WHERE d = 2),
y AS (SELECT m.doc_id, q, b.i, b.i - row_number() OVER (PARTITION BY m.doc_id, q ORDER BY b.i) AS g FROM m JOIN x b ON b.doc_id = m.doc_id JOIN x d ON d.doc_id = m.doc_id AND d.i = b.i + q WHERE b.word = d.word),
z AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM y GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM z GROUP BY ALL),
o AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
v AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN o USING (doc_id, i) GROUP BY doc_id),
u AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
b AS (SELECT a.* FROM r a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DECIMAL(38, 20) / period DESC, start, period) = 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN u USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN v USING (doc_id)
"""
