"""Near-duplicate documents by bottom-k sketches of one hash function.

Every shingle has one 64-bit hash. A sketch retains a document's k least values in one order of all
shingles, k = n - ceil(t n) + SHARED for n shingles and the threshold t: then two documents with
Jaccard t or more have SHARED retained values in common, for any order. The order is (commonness, hash): rare
shingles come first, so that inverted lists stay short and a passage or phrase that many documents
share leads to no list at all. Commonness is the log of a bucket's count over all documents, in a
table of fixed size; a bucket's collisions change the order and so the speed, never the result.

Equal sets are one node. Inverted lists of retained values give overlaps. A value is early in a node if
it is among its first n - ceil(2 t n / (1 + t)) + SHARED values. Of the first SHARED values that linked
nodes share, all are early in the smaller node: if it had more values before one of them, too few were
left to share. So only pairs of which one has the value early count, and a list where it is early in
no node is dropped: pages that share a template but have more than a ninth of shingles of their own
make no pair, whatever their number.

Linked nodes share either a list of more than SMALL nodes, or SHARED shorter ones. Of the shorter ones
pairs are counted; in the longer ones
1. a node is compared with the head that it shares most lists with;
2. in the lists that still have several components, with a node of the largest component, another
   one in each list;
3. in those that have several components even then, with the nodes of other components.
So a large group of near copies takes a few comparisons a node, not one a pair, and yet each pair of a
list that can be linked is compared or already known to be in one component. Lists of values that are
common are dealt to many tasks, each with a head of its own. Pairs are first held to two bounds that
lose no link, by sizes and by parity bitmaps, then to the union-sketch estimate, from the SKETCH least
hashes of both; the exact Jaccard of the full sets decides. The estimate's bar lies so low that a pair at t passes but for a chance of about 1e-9.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few_files, map_to_table, materialize, release, small_batches
from .graph import components
from .wordhash import mix, word_hashes

if TYPE_CHECKING:
    import pyarrow as pa

#: Buckets of the commonness table, half a byte each, broadcast; the chunks that it is summed by; hashes a task holds.
BUCKET_BITS, CHUNK_BITS, HELD = 25, 6, 1 << 19
#: Longest list whose pairs are counted, and how many retained values linked nodes share at least.
SMALL, SHARED = 8, 3
#: Levels of commonness from which a value's list is dealt to several tasks, of about 2**(HOT - 2) nodes each.
HOT = 12
#: Values of a union sketch, and the share of it that both must have, below t.
SKETCH, SLACK = 64, 0.35
#: Ids that are broadcast at most, 8 bytes each.
BROADCAST_ROWS = 1 << 20
#: 64-bit words of a node's parity bitmap, see _near().
WORDS = 16
BITS = [f"b{i}" for i in range(WORDS)]


def shingle_sets(texts: Sequence[str | None], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words, A-Z lower-cased; fewer words are one run; none without words."""
    out = []
    for h in word_hashes(texts):
        k = min(width, len(h))
        s = np.full(max(len(h) - k + 1, 0) if k else 0, k if k < width else 0, dtype=np.uint64)
        for i in range(k):
            s = (s ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(29)
        s = mix(s)
        s.sort()
        out.append(s[np.append(True, s[1:] != s[:-1])] if len(s) else s)
    return out


def retained(n: int, percent: int) -> int:
    """How many values: two sets at the threshold have SHARED of them in common, as they have so many at all unless they are equal."""
    return min(n, n - -(-percent * n // 100) + SHARED)


def early(n: int, percent: int) -> int:
    """In how many of its first values a set of n can meet a set that is no smaller: see above."""
    return n - -(-2 * percent * n // (100 + percent)) + SHARED


def _commonness(docs: DataFrame, width: int) -> bytes:
    """The level of each bucket of shingle hashes, bits of its count up to 15; two levels a byte."""
    part = 1 << BUCKET_BITS - CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        release()
        held: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            got, n = np.unique(np.concatenate(held) if held else np.empty(0, dtype=np.uint32), return_counts=True)
            chunk = got >> np.uint32(BUCKET_BITS - CHUNK_BITS)
            at = np.searchsorted(chunk, np.arange((1 << CHUNK_BITS) + 1))
            gaps = np.minimum(np.diff(got, prepend=np.uint32(0)), (1 << 32) - 1).astype("<u4")
            n = np.minimum(n, 255).astype(np.uint8)
            rows = [(c, int(got[i]), zlib.compress(gaps[i:j].view(np.uint8).reshape(-1, 4).T.tobytes() + n[i:j].tobytes(), 1)) for c, (i, j) in enumerate(zip(at, at[1:], strict=False)) if i < j]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["chunk", "first", "counts"])

        for b in batches:
            held += [(s >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32) for s in shingle_sets(b.column("text").to_pylist(), width)]
            if sum(map(len, held)) > HELD:
                yield send()
                held = []
        yield send()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, first, raw in zip(*(b.column(c).to_pylist() for c in ("chunk", "first", "counts")), strict=True):
                data = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
                k = len(data) // 5
                gaps = np.ascontiguousarray(data[: 4 * k].reshape(4, k).T).view("<u4").ravel().astype(np.int64)
                gaps[0] = first
                sums.setdefault(chunk, np.zeros(part, dtype=np.int64))[np.cumsum(gaps) - chunk * part] += data[4 * k :]
        rows = []
        for c, x in sums.items():
            level = np.minimum(15, np.ceil(np.log2(x + 1))).astype(np.uint8)
            rows.append((c, (level[::2] | level[1::2] << 4).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "levels"])

    sent = docs.select("text").mapInArrow(count, "chunk int, first long, counts binary").repartition(1 << CHUNK_BITS, "chunk")
    rows = {r["chunk"]: bytes(r["levels"]) for r in sent.mapInArrow(total, "chunk int, levels binary").collect()}
    return b"".join(rows.get(c, bytes(part // 2)) for c in range(1 << CHUNK_BITS))


def _level(packed: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return packed[bucket >> np.uint64(1)] >> ((bucket & np.uint64(1)) << np.uint64(2)).astype(np.uint8) & np.uint8(15)


def _sketches(docs: DataFrame, width: int, percent: int, rows: int) -> DataFrame:
    """doc_id, n, sig (of the whole set), kept (retained values in their order; the lowest bit tells those that aren't early), sketch (least hashes, 4 bytes each), b0 ... (parity bitmap)."""
    sent = docs.sparkSession.sparkContext.broadcast(_commonness(docs, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import xxhash

        packed = np.frombuffer(sent.value, dtype=np.uint8)
        for b in batches:
            sets = shingle_sets(b.column("text").to_pylist(), width)
            kept, bits = [], []
            for s in sets:
                order = _level(packed, s >> np.uint64(64 - BUCKET_BITS)).astype(np.uint64) << np.uint64(57) | s >> np.uint64(7)
                k = retained(len(s), percent)
                order = np.sort(np.partition(order, k - 1)[:k]) if k else order
                order = order & ~np.uint64(1) | (np.arange(k) >= early(len(s), percent)).astype(np.uint64)
                kept.append(order.view(np.int64))
                odd = np.bincount((s & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view("<i8"))
            ends = np.concatenate(([0], np.cumsum([len(k) for k in kept]))).astype(np.int32)
            wide = np.array(bits, dtype=np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(ends, np.concatenate([*kept, np.empty(0, dtype=np.int64)])), pa.array([(s[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes() for s in sets], pa.binary()),
                    *[pa.array(np.ascontiguousarray(wide[:, i])) for i in range(WORDS)],
                ],
                ["doc_id", "n", "sig", "kept", "sketch", *BITS],
            )

    made = map_to_table(docs, run, "doc_id long, n long, sig binary, kept array<long>, sketch binary, " + ", ".join(f"{b} long" for b in BITS), "sketches", rows)
    sent.unpersist()
    return made


def _lists(nodes: DataFrame, rows: int) -> DataFrame:
    """Inverted lists of two nodes or more that hold a value early. Of a list of up to SMALL nodes (null, a, b, true) for
    each pair of which one has it early; of a longer one (value, node, head, early) for each node, where the head is the
    smallest node that has it early.

    Lists are read as a sorted stream, so that no list has to fit in memory. The list of a common value is dealt by
    node to several parts, all of them in the longer form.
    """
    post = nodes.select(F.explode("kept").alias("v"), F.col("doc_id").alias("node"))
    level = F.shiftright("v", 57)
    # counts end at the top level: there may be as many nodes as rows
    parts = F.when(level >= 15, F.lit(max(32, rows >> HOT))).otherwise(F.pow(F.lit(2), level - (HOT - 2)).cast("long"))
    part = F.when(level >= HOT, F.pmod(F.xxhash64("node"), parts)).otherwise(-1)
    post = post.withColumn("part", part.cast("int")).withColumn("value", F.shiftright("v", 1))
    # in order of v, nodes that have the value early come first
    post = post.repartition("value", "part").sortWithinPartitions("value", "part", "v", "node").select("v", "part", "node")

    def made(v: np.ndarray | None, node: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
        import pyarrow as pa

        first = np.ones(len(node), dtype=bool) if v is None else v & 1 == 0
        return pa.RecordBatch.from_arrays([pa.nulls(len(node), pa.int64()) if v is None else pa.array(v >> 1), pa.array(node), pa.array(head), pa.array(first)], ["value", "node", "head", "early"])

    def new(v: np.ndarray, part: np.ndarray) -> np.ndarray:
        return np.append(True, (v[1:] >> 1 != v[:-1] >> 1) | (part[1:] != part[:-1]))

    def whole(v: np.ndarray, part: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(v):
            return
        at = np.flatnonzero(new(v, part))
        size = np.diff(np.append(at, len(v)))
        of = np.repeat(size, size)
        some = np.repeat(v[at] & 1 == 0, size)
        if (big := (some & (of > SMALL)) | (part >= 0)).any():
            yield made(v[big], node[big], np.repeat(node[at], size)[big])
        on = some & ~big
        v, node = v[on], node[on]
        for d in range(1, min(SMALL, len(v))):
            same = (v[d:] >> 1 == v[:-d] >> 1) & (v[:-d] & 1 == 0)
            if same.any():
                yield made(None, node[:-d][same], node[d:][same])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ("v", "part", "node"), [np.empty(0, dtype=t) for t in (np.int64, np.int32, np.int64)]
        opened, head = None, None  # a long list of which rows are out already, and its head; none: rows are left out
        for b in batches:
            v, part, node = (np.concatenate((x, b.column(c).to_numpy())) for x, c in zip(held, names, strict=True))
            if opened is not None and len(v):
                other = np.flatnonzero((v >> 1 != opened[0]) | (part != opened[1]))
                k = int(other[0]) if len(other) else len(v)
                if head is not None and k:
                    yield made(v[:k], node[:k], np.full(k, head))
                v, part, node = v[k:], part[k:], node[k:]
            held = [v, part, node]
            if not len(v):
                continue
            last = int(np.flatnonzero(new(v, part))[-1])
            yield from whole(v[:last], part[:last], node[:last])
            v, part, node, opened = v[last:], part[last:], node[last:], None
            if len(v) > SMALL:
                opened, head = (v[0] >> 1, part[0]), node[0] if v[0] & 1 == 0 or part[0] >= 0 else None
                if head is not None:
                    yield made(v, node, np.full(len(v), head))
                v, part, node = v[:0], part[:0], node[:0]
            held = [v, part, node]
        yield from whole(*held)

    return map_to_table(post, run, "value long, node long, head long, early boolean", "lists", rows)


def _near(percent: int, left: str = "x", right: str = "y") -> Column:
    """Whether two nodes can be linked by their sizes, <side>n, and parity bitmaps, <side>b0 and so on.

    A bit is the parity of the shingles that fall on it, so bitmaps differ in at most as many bits as the
    sets in shingles. Sets with Jaccard t differ in at most (1 - t) / (1 + t) of the sum of their sizes.
    """
    n, m = F.col(left + "n"), F.col(right + "n")
    differ = sum((F.bit_count(F.col(left + b).bitwiseXOR(F.col(right + b))) for b in BITS), F.lit(0))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ * (100 + percent) <= (n + m) * (100 - percent))


def _named(nodes: DataFrame, side: str) -> DataFrame:
    """doc_id as the side's name, with its size and bitmap."""
    return nodes.select(F.col("doc_id").alias(side), *[F.col(c).alias(side + c) for c in ("n", *BITS)])


def _linked(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, width: int, percent: int, rows: int) -> DataFrame:
    """The distinct pairs (a, b) that are linked, as a table."""
    least = percent / 100 - SLACK
    def likely(p: bytes, q: bytes) -> bool:
        both = np.concatenate((np.frombuffer(p, dtype="<u4"), np.frombuffer(q, dtype="<u4")))
        both.sort()
        same = np.append(both[1:] == both[:-1], False)
        first = np.insert(both[1:] != both[:-1], 0, True)
        k = min(SKETCH, int(first.sum()))
        return int((same & (both <= both[first][k - 1])).sum()) >= least * k

    def alike(p: bytes, q: bytes) -> bool:
        both = np.concatenate((np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)))
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= percent * (len(both) - common)

    def only(test):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow as pa

            for b in batches:
                x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
                yield b.select(["a", "b"]).filter(pa.array([test(p, q) for p, q in zip(x, y, strict=True)], pa.bool_()))

        return run

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(b.column("text").to_pylist(), width)], pa.binary())], ["doc_id", "s"])

    def both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
        pairs = pairs.join(of.select(F.col("doc_id").alias("a"), F.col(column).alias("x")), "a")
        return pairs.join(of.select(F.col("doc_id").alias("b"), F.col(column).alias("y")), "b").select("a", "b", "x", "y")

    pairs = map_to_table(both(pairs, sketches, "sketch"), only(likely), "a long, b long", "pairs", rows)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    small = pairs.count() * 2 <= BROADCAST_ROWS
    sets = map_to_table(docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi"), whole_sets, "doc_id long, s binary", "sets", rows)
    return map_to_table(both(pairs, sets, "s"), only(alike), "a long, b long", "links", rows)


def _mixed(lists: DataFrame, groups: DataFrame, rows: int) -> tuple[DataFrame, DataFrame] | None:
    """(value, node, early, c: component) of the lists with several components, and (value, main: the largest of them); none if there are none."""
    of = groups.select("node", F.col("component").alias("c"))
    placed = lists.join(of, "node", "left").withColumn("c", F.coalesce("c", "node"))
    sizes = placed.groupBy("value", "c").agg(F.count(F.lit(1)).alias("k"), F.max("early").alias("early"))
    main = sizes.groupBy("value").agg(F.max(F.struct("k", "c"))["c"].alias("main"), F.count(F.lit(1)).alias("m"), F.max("early").alias("early"))
    main = materialize(main.where("m > 1 and early").select("value", "main"), "main", rows)
    if main.isEmpty():
        return None
    return materialize(placed.join(main.select("value"), "value", "left_semi"), "placed", rows), main


def _pairs(left: DataFrame, right: DataFrame, sides: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, of left (value, x, cx, ex: early, main) and right (value, y, cy, ey) in one list and different components, that can be linked.

    Where right's component isn't main, right is also in left, and each pair is taken once; main may be null. The
    smaller one has the value early, of two of one size both. All of this is decided inside the join, which gives
    only pairs that pass; rows never meet where neither has the value early.
    """
    left, right = left.join(_named(sides, "x"), "x"), right.join(_named(sides, "y"), "y")
    first = (F.col("ex") | (F.col("xn") > F.col("yn"))) & (F.col("ey") | (F.col("yn") > F.col("xn")))
    once = F.expr("cx <> cy and (main is null or cy = main or x < y)")

    def met(some: DataFrame, others: DataFrame) -> DataFrame:
        return some.join(others, "value").where(once & first & _near(percent)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    return met(left.where("ex"), right).union(met(left.where("not ex"), right.where("ey"))).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Documents link if 100 * intersection >= percent * union of their sets of `width`-word shingles.
    component_id is the smallest doc_id that links reach. Null texts and texts without words have an
    empty set and link with nothing. A row with a null doc_id takes no part: component_id is null and
    it is kept. Repeated rows stay, with one component; rows of one doc_id are one document. Texts are
    whole; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = docs.count()
    made = _sketches(docs, width, percent, rows)
    some = made.where("n > 0 and doc_id is not null")
    firsts = some.groupBy("sig").agg(F.min("doc_id").alias("node"))
    nodes = some.join(firsts, "sig").where("doc_id = node")
    found = _lists(nodes.select("doc_id", "kept"), rows)
    lists = found.where("value is not null").select("value", "node", "head", "early")

    sides = some.select("doc_id", "n", *BITS)
    # 1: overlaps in short lists, and the head that a node shares most long lists with
    short = found.where("value is null").groupBy(F.least("node", "head").alias("x"), F.greatest("node", "head").alias("y")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= SHARED)
    short = short.join(_named(sides, "x"), "x").join(_named(sides, "y"), "y").where(_near(percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    votes = lists.where("node <> head").groupBy(F.col("node").alias("y"), F.col("head").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    votes = votes.join(_named(sides, "x"), "x").join(_named(sides, "y"), "y").where(_near(percent))
    best = votes.groupBy("y").agg(F.max(F.struct(F.col("c"), (-F.col("x")).alias("x")))["x"].alias("x"))
    best = best.select((-F.col("x")).alias("x"), "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    tried = materialize(best.union(short).distinct(), "tried", rows)
    links = _linked(tried, docs, made, width, percent, rows)
    groups = components(links, rows)
    # 2: in each list that has several components still, a node of the largest one, if possible one that has the value early
    if mixed := _mixed(lists.select("value", "node", "early"), groups, rows):
        placed, main = mixed
        pivot = placed.join(main, "value").where("c = main").groupBy("value").agg(F.min_by(F.struct("node", "early"), F.struct(~F.col("early"), F.xxhash64("value", "node"))).alias("p"))
        pivot = pivot.select("value", F.col("p.node").alias("x"), F.col("p.early").alias("ex")).join(main, "value").select("value", "x", F.col("main").alias("cx"), "ex", F.lit(None).cast("long").alias("main"))
        named = placed.select("value", F.col("node").alias("y"), F.col("c").alias("cy"), F.col("early").alias("ey"))
        pairs = _pairs(pivot, named, sides, percent).join(tried, ["a", "b"], "left_anti")
        more = _linked(pairs, docs, made, width, percent, rows)
        groups = components(more.union(groups.select("component", "node")), rows)
        # 3: what is left, exactly: the nodes outside a list's largest component with nodes of others
        if mixed := _mixed(placed.select("value", "node", "early"), groups, rows):
            placed, main = mixed
            named = placed.select("value", F.col("node").alias("y"), F.col("c").alias("cy"), F.col("early").alias("ey"))
            rest = placed.join(main, "value").where("c <> main").select("value", F.col("node").alias("x"), F.col("c").alias("cx"), F.col("early").alias("ex"), "main")
            pairs = _pairs(rest, named, sides, percent).join(tried, ["a", "b"], "left_anti")
            more = _linked(pairs, docs, made, width, percent, rows)
            groups = components(more.union(groups.select("component", "node")), rows)

    node_of = firsts.join(groups, "node", "left").select("sig", F.coalesce("component", "node").alias("component_id"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = made.select("doc_id", "n", "sig").join(node_of, "sig", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), own))
    return few_files(out, rows).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * k >= 80 * (na + nb - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM s LEFT JOIN c ON a = doc_id
"""
