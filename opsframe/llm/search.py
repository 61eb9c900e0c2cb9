"""Exact top-k search by BM25: a sharded inverted index with block-max WAND pruning.

Shards index their documents alone, but with the corpus' average length, and queries carry the corpus'
document frequencies, so scores don't depend on the shards and their top k merge exactly.

A shard holds its distinct texts, each with the ids of its copies, in an order that puts texts with the
same leading word and like lengths side by side, and cuts it into blocks of BLOCK texts. Each posting
list is sorted by text and knows its part in each block: where it starts and its largest impact. The
blocks are the same ranges of texts for all lists, so a list's cursor moves from block to block, and
WAND's pivot test, whether the maxima of the lists that are present can add up to the threshold, is
taken for all blocks of a query at once. Where it fails, every list skips its part of the block.

The threshold is a query's k-th best score so far. A query's blocks with the highest sums come first,
which raises it, each block raises it further, and a task takes it along from shard to shard and returns
k rows a query. So there are (groups of shards) x k rows a query before the merge, however many shards there are.

Lists that many of a block's texts have are rows of its tile, a small dense matrix of impacts. In a block
that passes, the weights of all queries that ask there are multiplied with it at once, in single
precision; then the test is taken again with these sums in place of the maxima, and only where it holds
are the other lists' postings read. What reaches the threshold within the error of that is scored again
in double precision, from the terms that a text has.

Shards are files in the shared folder. A task is a block of queries and a group of shards, and holds
one shard at a time.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, small_batches
from .lm import _block, _merge, _sent, shard_of
from .warc import store
from .wordhash import word_hashes

K1, B = 1.2, 0.75
#: Documents of a shard, texts of a block, most rows of a block's tile; a list is dense in a block where more than one in DENSE of its
#: texts has it; of a query's blocks one in FIRST is scored before the others.
SHARD, BLOCK, COMMON, DENSE, FIRST = 16384, 2048, 1024, 20, 16
#: Queries that a task asks, and how many of them at once; groups of shards at least, if there are so many shards.
TASK_QUERIES, QUERY_BLOCK, GROUPS = 2048, 128, 12
#: Hashes that a task holds before it sends their counts; relative error of single precision sums, with room.
HELD, ERROR = 1 << 21, 1e-4

Bag = tuple[np.ndarray, np.ndarray]


def bags(texts: Sequence[str | None]) -> list[Bag]:
    """For each text the sorted hashes of its distinct words (A-Z lower-cased; letters, digits and all beyond ASCII) and how often each occurs."""
    return [(t, n.astype(np.int32)) for t, n in (np.unique(h, return_counts=True) for h in word_hashes(texts, letters=True))]


def _frequencies(docs: DataFrame, shards: int) -> DataFrame:
    """(term, df, words): a row per term, and one with a null term for the number of words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        words = 0

        def send() -> pd.DataFrame:
            keys, n = np.unique(np.concatenate(held) if held else np.empty(0, dtype=np.uint64), return_counts=True)
            return _sent(keys, n, shard_of(keys, shards)).assign(words=0)

        for b in batches:
            for t, n in bags(b["text"]):
                held.append(t)
                words += int(n.sum())
            if sum(map(len, held)) > HELD:
                yield send()
                held = []
        yield send()
        yield pd.DataFrame({"shard": [-1], "n": [0], "keys": [_block(np.empty(0, dtype=np.uint64), np.empty(0))], "words": [words]}).astype({"shard": "int32", "n": "int32"})

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pd.DataFrame({"term": [None], "df": [0], "words": [int(rows["words"].sum())]}).astype({"term": "Int64"})
        keys, counts = _merge(list(zip(rows["keys"], rows["n"], strict=True)))
        return pd.DataFrame({"term": keys.view(np.int64), "df": counts, "words": 0}).astype({"term": "Int64"})

    return docs.select("text").mapInPandas(count, "shard int, n int, keys binary, words long").groupBy("shard").applyInPandas(merge, "term long, df long, words long")


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, end), one after another."""
    size = ends - starts
    return np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, dtype=np.int64)


class Shard:
    """The index of some documents. scored counts the postings of sparse lists that were read, skipped those that a pass left out, so one that
    the first pass leaves to the second counts there too."""

    #: ids: of all copies, by text; id_at: where a text's begin; norm: of each text; terms: sorted; doc, tf: postings by (term, text);
    #: parts: where lists' parts begin; part_at: the first part of each term; own, own_tf: numbers of a text's terms, by (text, term); own_at: where a text's begin.
    ARRAYS = ("ids", "id_at", "norm", "terms", "doc", "tf", "parts", "part_at", "own", "own_tf", "own_at")

    def __init__(self, arrays: dict[str, np.ndarray], block: int = BLOCK, common: int = COMMON):
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])
        n, self.block, self.blocks = len(self.norm), block, -(-len(self.norm) // block)
        self.copies = np.diff(self.id_at)
        self.impact = (self.tf * (K1 + 1) / (self.tf + self.norm[self.doc])).astype(np.float32)
        size = np.diff(self.parts)
        self.part_block = (self.doc[self.parts[:-1]] // block).astype(np.min_scalar_type(self.blocks))
        self.part_max = np.maximum.reduceat(self.impact, self.parts[:-1]) if len(size) else np.empty(0, dtype=np.float32)
        # the block's row of a part whose list is dense there
        self.row_of = np.full(len(size), -1, dtype=np.int32)
        self.tiles: list[np.ndarray] = []
        often = np.flatnonzero(size > max(1, block // DENSE))
        for b in range(self.blocks):
            part = often[self.part_block[often] == b]
            if len(part) > common:
                part = np.sort(part[np.argsort(-size[part], kind="stable")[:common]])
            self.row_of[part] = np.arange(len(part))
            tile = np.zeros((len(part), min(block, n - b * block)), dtype=np.float32)
            posts = _spans(self.parts[part], self.parts[part + 1])
            tile[np.repeat(np.arange(len(part)), size[part]), self.doc[posts] - b * block] = self.impact[posts]
            self.tiles.append(tile)
        self.weight = np.zeros(len(self.terms))
        self.scored = self.skipped = 0

    @classmethod
    def arrays(cls, ids: list, docs: list[Bag], average: float, block: int = BLOCK) -> dict[str, np.ndarray]:
        """What a shard of these documents is made of."""
        import xxhash

        same: dict[bytes, tuple[np.ndarray, np.ndarray, list[int]]] = {}
        for i, (t, n) in zip(ids, docs, strict=True):
            same.setdefault(xxhash.xxh3_128_digest(t.tobytes() + n.tobytes()), (t, n, []))[2].append(i)
        texts = [(t, n, sorted(x)) for t, n, x in same.values() if len(t)]
        # the leading word is mostly a language's: texts that share many words lie together
        texts.sort(key=lambda x: (int(x[0][x[1].argmax()]), int(x[1].sum()), x[2][0]))
        length = np.array([n.sum() for _, n, _ in texts], dtype=np.float64)
        join = lambda xs, kind: np.concatenate([*xs, np.empty(0, dtype=kind)]).astype(kind)
        term, tf = join([t for t, _, _ in texts], np.uint64), join([n for _, n, _ in texts], np.int32)
        tf = tf.astype(np.min_scalar_type(int(tf.max()) if len(tf) else 0))
        sizes = [len(t) for t, _, _ in texts]
        doc = np.repeat(np.arange(len(texts), dtype=np.uint32), sizes)
        order = np.argsort(term, kind="stable")
        term, doc, own_tf = term[order], doc[order], tf
        at = _firsts(term)
        new = np.zeros(len(term) + 1, dtype=bool)
        new[at] = True
        own = np.empty(len(term), dtype=np.uint32)
        own[order] = np.cumsum(new[:-1], dtype=np.uint32) - np.uint32(1)
        new[1:-1] |= doc[1:] // block != doc[:-1] // block
        parts = np.flatnonzero(new[:-1])
        return {
            "ids": join([x for _, _, x in texts], np.int64), "id_at": np.cumsum([0, *[len(x) for _, _, x in texts]]), "norm": K1 * (1 - B + B * length / max(average, 1e-9)),
            "terms": term[at], "doc": doc, "tf": tf[order], "parts": np.append(parts, len(term)), "part_at": np.append(np.searchsorted(parts, at), len(parts)),
            "own": own, "own_tf": own_tf, "own_at": np.cumsum([0, *sizes]),
        }

    def _terms(self, query: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the query's terms that occur here, their weights)."""
        t, w = query
        if not len(self.terms):
            return np.empty(0, dtype=np.int64), w[:0]
        at = np.minimum(np.searchsorted(self.terms, t), len(self.terms) - 1)
        hit = self.terms[at] == t
        return at[hit], w[hit]

    def _score(self, b: int, number: np.ndarray, least: np.ndarray, rest: np.ndarray, asked: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Scores by query and text of block b, 0 where no score of the block can reach least. number: of each query, -1 for those that don't ask
        here; least and rest: of those that do, rest being what the maxima of the sparse lists add up to; asked: the parts of all queries' lists, whose queries, their weights.

        The tile comes first; with its sums in place of their maxima the pivot test is taken again, before postings are read.
        """
        part, query, weight = asked
        tile, query = self.tiles[b], number[query]
        row = self.row_of[part]
        dense = (row >= 0) & (query >= 0)
        by_row = np.zeros((len(least), len(tile)), dtype=np.float32)
        by_row[query[dense], row[dense]] = weight[dense]
        got = by_row @ tile
        out = (got.max(axis=1) + rest) * (1 + ERROR) < least
        got[out] = 0
        sparse = (row < 0) & (query >= 0)
        part, query, weight = part[sparse], query[sparse], weight[sparse]
        size = self.parts[part + 1] - self.parts[part]
        on = ~out[query]
        self.skipped += int(size[~on].sum())
        part, query, weight, size = part[on], query[on], weight[on], size[on]
        self.scored += int(size.sum())
        posts = _spans(self.parts[part], self.parts[part] + size)
        cell = np.repeat(query * tile.shape[1] - b * self.block, size) + self.doc[posts]
        got += np.bincount(cell, weights=np.repeat(weight, size) * self.impact[posts], minlength=got.size).reshape(got.shape)
        return got

    def exact(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores in double precision, summed in the order of the terms."""
        self.weight[terms] = weights
        size = self.own_at[docs + 1] - self.own_at[docs]
        posts, each = _spans(self.own_at[docs], self.own_at[docs + 1]), np.repeat(np.arange(len(docs)), size)
        weight = self.weight[self.own[posts]]
        hit = np.flatnonzero(weight)
        weight, posts, each = weight[hit], posts[hit], each[hit]
        tf = self.own_tf[posts].astype(np.float64)
        got = np.bincount(each, weights=weight * (tf * (K1 + 1) / (tf + self.norm[docs][each])), minlength=len(docs))
        self.weight[terms] = 0
        return got

    def _raise(self, found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of found (queries, texts, scores) that may be among the k best, by query and falling score; raises least."""
        order = np.lexsort((-found[2], found[0]))
        q, d, s = (x[order] for x in found)
        first = _firsts(q)
        n = np.cumsum(self.copies[d])
        before = n[first] - self.copies[d[first]]
        at = np.searchsorted(n, before + k)
        full = at < np.append(first[1:], len(q))
        least[q[first[full]]] = np.maximum(least[q[first[full]]], s[at[full]] * (1 - ERROR))
        kept = s >= least[q]
        return q[kept], d[kept], s[kept]

    def best(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (sorted terms, weights) the (doc_ids, scores) of its k best documents here whose score is positive and reaches least; ties by id."""
        none = np.empty(0, dtype=np.int64), np.empty(0)
        if not self.blocks:
            return [none] * len(queries)
        m, here = len(queries), [self._terms(q) for q in queries]
        lists = np.concatenate([t for t, _ in here])
        lo, hi = self.part_at[lists], self.part_at[lists + 1]
        part, query = _spans(lo, hi), np.repeat(np.repeat(np.arange(m), [len(t) for t, _ in here]), hi - lo)
        weight = np.repeat(np.concatenate([w for _, w in here]).astype(np.float32), hi - lo)
        block = self.part_block[part]
        order = np.argsort(block, kind="stable")
        part, query, weight, block = part[order], query[order], weight[order], block[order]
        edge = np.searchsorted(block, np.arange(self.blocks + 1))
        most, cell, sparse = weight * self.part_max[part], block.astype(np.int64) * m + query, self.row_of[part] < 0
        bound = np.bincount(cell, weights=most, minlength=self.blocks * m).reshape(self.blocks, m)
        rest = np.bincount(cell[sparse], weights=most[sparse], minlength=self.blocks * m).reshape(self.blocks, m)
        least, top = least * (1 - ERROR), np.zeros(bound.shape, dtype=bool)
        first = -(-self.blocks // FIRST)
        np.put_along_axis(top, np.argpartition(bound, -first, axis=0)[-first:], True, axis=0)
        found = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        # a query's best blocks first: they raise the threshold for all others
        for early in (True, False):
            for b in np.argsort(-bound.sum(axis=1)):
                wanted = top[b] == early
                live = wanted & (bound[b] > 0) & (bound[b] * (1 + ERROR) >= least)
                own = slice(edge[b], edge[b + 1])
                off = part[own][sparse[own] & ~live[query[own]]]
                self.skipped += int((self.parts[off + 1] - self.parts[off]).sum())
                asks = np.flatnonzero(live)
                if not len(asks):
                    continue
                number = np.full(m, -1, dtype=np.int64)
                number[asks] = np.arange(len(asks))
                got = self._score(b, number, least[asks], rest[b, asks], (part[own], query[own], weight[own]))
                if early and got.shape[1] > k:
                    # copies only raise the k-th best score
                    least[asks] = np.maximum(least[asks], np.partition(got, -k, axis=1)[:, -k] * (1 - ERROR))
                i, d = np.nonzero((got >= least[asks, None]) & (got > 0))
                if len(i):
                    more = asks[i], d + b * self.block, got[i, d].astype(np.float64)
                    found = self._raise(tuple(np.concatenate(x) for x in zip(found, more, strict=True)), k, least)
        out = [none] * m
        at = np.append(_firsts(found[0]), len(found[0]))
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            i, d = int(found[0][lo]), found[1][lo:hi]
            size = np.minimum(self.copies[d], k)
            value = np.repeat(self.exact(d, *here[i]), size)
            ids = self.ids[_spans(self.id_at[d], self.id_at[d] + size)]
            order = np.lexsort((ids, -value))[:k]
            out[i] = ids[order], value[order]
        return out


def _save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Write a shard under a name of this attempt's own."""
    name = f"{folder}/shard-{uuid.uuid4().hex}"
    fs, path = store(name)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        for x in Shard.ARRAYS:
            np.lib.format.write_array(out, np.ascontiguousarray(arrays[x]), allow_pickle=False)
    return name


def _load(name: str) -> dict[str, np.ndarray]:
    fs, path = store(name)
    with fs.open_input_stream(path, compression=None) as f:
        return {x: np.lib.format.read_array(f, allow_pickle=False) for x in Shard.ARRAYS}


def _index(docs: DataFrame, average: float, tasks: int, folder: str) -> list[str]:
    """The files of the shards: as many as tasks, or more where a task has more than SHARD documents."""
    size, block = SHARD, BLOCK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        held: list[Bag] = []
        for b in batches:
            for i, bag in zip(b["doc_id"], bags(b["text"]), strict=True):
                ids.append(i)
                held.append(bag)
                if len(ids) == size:
                    yield pd.DataFrame({"file": [_save(folder, Shard.arrays(ids, held, average, block))]})
                    ids, held = [], []
        if ids:
            yield pd.DataFrame({"file": [_save(folder, Shard.arrays(ids, held, average, block))]})

    return sorted(r["file"] for r in docs.coalesce(tasks).mapInPandas(run, "file string").collect())


def _weights(queries: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """(query_id, lead, terms, weights): its leading word, the known terms of each query, and (occurrences) x (idf)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = bags(b["text"])
            yield pd.DataFrame({"query_id": b["query_id"], "lead": [int(t.view(np.int64)[c.argmax()]) if len(t) else 0 for t, c in got], "q": [[{"term": int(t), "n": int(c)} for t, c in zip(g[0].view(np.int64), g[1], strict=True)] for g in got]})

    asked = queries.mapInPandas(split, "query_id long, lead long, q array<struct<term: long, n: long>>").select("query_id", "lead", F.inline("q"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.groupBy("query_id", "term").agg(F.max("n").alias("n"), F.min("lead").alias("lead")).join(df, "term").select("query_id", "lead", F.struct("term", (F.col("n") * idf).alias("weight")).alias("q"))
    asked = asked.groupBy("query_id").agg(F.min("lead").alias("lead"), F.array_sort(F.collect_list("q")).alias("q"))
    return asked.select("query_id", "lead", F.col("q.term").alias("terms"), F.col("q.weight").alias("weights"))


def _by_block(df: DataFrame, blocks: int, name: str) -> str:
    """The folder that df is written to, a folder in it for each block of queries."""
    path = fresh_path(df.sparkSession, name)
    df.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).repartition(blocks, "block").write.partitionBy("block").parquet(path)
    return path


def _read(path: str, block: int, columns: list[str]):
    import pyarrow.dataset as ds
    from pyarrow.fs import FileType

    fs, folder = store(f"{path}/block={block}")
    if fs.get_file_info(folder).type == FileType.NotFound:
        return None
    return ds.dataset(folder, filesystem=fs, format="parquet").to_table(columns=columns)


def _asked(path: str, block: int) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
    """(ids, queries) of a block of queries; those with the same leading word lie together, as texts do."""
    rows = _read(path, block, ["query_id", "terms", "weights", "lead"])
    ids, out, lead = [], [], []
    for q, t, w, first in zip(*(rows.column(c) for c in rows.column_names), strict=True) if rows else ():
        t = t.values.to_numpy(zero_copy_only=False).view(np.uint64)
        order = np.argsort(t)
        ids.append(q.as_py())
        out.append((t[order], w.values.to_numpy(zero_copy_only=False)[order]))
        lead.append(first.as_py())
    order = np.lexsort((ids, lead)) if ids else []
    return [ids[i] for i in order], [out[i] for i in order]


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), doc_id, score: for each row of queries (query_id, text) its k best rows of docs (doc_id, text).

    Whole texts are indexed and asked. A query that repeats a word counts it as often. Only documents
    that share a word with the query are found, so there may be fewer than k; a null or empty text finds
    nothing and is never found. Scores tie by doc_id. Rows with null ids are left out, repeated rows are
    found as often as they occur; queries that repeat an id share one result list. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    queries = queries.select(F.col("query_id").cast("long"), F.col("text").cast("string")).where("query_id is not null and text is not null")
    n = docs.count()
    made = fresh_path(spark, "frequencies")
    _frequencies(docs, max(4, n // 16384)).write.parquet(made)
    df = spark.read.schema("term long, df long, words long").parquet(made)
    words = df.where("term is null").agg(F.sum("words")).first()[0] or 0
    shards = _index(docs, words / max(n, 1), max(12, -(-n // SHARD)), fresh_path(spark, "index"))

    asked = materialize(_weights(queries, df, n), "asked", 0)
    blocks = max(1, -(-asked.count() // TASK_QUERIES))
    path = _by_block(asked, blocks, "questions")
    groups = max(1, min(len(shards), max(GROUPS, -(-4 * spark.sparkContext.defaultParallelism // blocks))))
    sent = spark.sparkContext.broadcast(shards)
    block, common, at_once = BLOCK, COMMON, QUERY_BLOCK
    tasks = spark.range(0, groups * blocks, 1, groups * blocks)

    def of_task(task: int) -> Iterator[Shard]:
        for name in sent.value[task % groups :: groups]:
            yield Shard(_load(name), block, common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for task in (int(i) for b in batches for i in b["id"]):
            ids, asked_ = _asked(path, task // groups)
            best = [(np.empty(0, dtype=np.int64), np.empty(0))] * len(ids)
            for shard in of_task(task) if ids else ():
                for i in range(0, len(ids), at_once):
                    have = best[i : i + at_once]
                    least = np.array([s[-1] if len(s) == k else 0.0 for _, s in have])
                    for j, (h, f) in enumerate(zip(have, shard.best(asked_[i : i + at_once], k, least), strict=True), i):
                        d, s = np.concatenate((h[0], f[0])), np.concatenate((h[1], f[1]))
                        order = np.lexsort((d, -s))[:k]
                        best[j] = d[order], s[order]
            named = np.repeat(np.array(ids, dtype=np.int64), [len(d) for d, _ in best])
            yield pd.DataFrame({"query_id": named, "doc_id": np.concatenate([named[:0], *[d for d, _ in best]]), "score": np.concatenate([np.empty(0), *[s for _, s in best]])})

    found = tasks.mapInPandas(run, "query_id long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def brute_force(docs: list[tuple[int, str | None]], queries: list[tuple[int, str | None]], k: int) -> list[tuple]:
    """The same by scoring every document, for tests."""
    words = lambda t: Counter(re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()))
    all_ = [(i, words(t)) for i, t in docs]
    average = sum(sum(b.values()) for _, b in all_) / max(len(all_), 1)
    df = Counter(t for _, b in all_ for t in b)
    out = []
    for q, text in queries:
        asked, scored = words(text), []
        for i, b in all_:
            norm = K1 * (1 - B + B * sum(b.values()) / max(average, 1e-9))
            s = sum(n * math.log(1 + (len(all_) - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * (K1 + 1) / (b[t] + norm) for t, n in asked.items() if t in b)
            if s > 0:
                scored.append((-s, i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out
