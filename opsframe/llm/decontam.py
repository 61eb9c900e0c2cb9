"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Words are hashed as K-grams; of every W consecutive K-grams the least hash is kept. A shared span of
WINDOW = W + K - 1 words has the same W hashes in document and item, so both keep its least one:
joining kept hashes misses no shared window. Windows in a row with the same least hash share one mark,
at most W of them, which has the hashes of the K-grams there, so that a match is extended to them
without the text. A window of 10 words is told by the hashes of its first and its last 6 words, which
cover it: 128 bits.

Documents are read once: each gives a row for itself and a row per kept hash. Kept hashes, windows and
sets of items are each broadcast if their own number, for sets that of all their ids, is at most BROADCAST_ROWS, else
they are joined by a shuffle, in which rows without a value are spread by document. Windows, not item pairs, are joined, and windows that the same items have share one set of items,
so a passage of many items or documents makes one row a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, few_files, materialize, text_key

#: What lies between words: fixed value.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, K = 10, 6
W = WINDOW - K + 1
#: Rows of each of the items' tables that are broadcast at most, 8 bytes a kept hash or id and 24 a window.
BROADCAST_ROWS = 1 << 20
#: Files of the items' tables at most.
PARTS = 64


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def words(text: Column) -> Column:
    """Hashes of the words; empty for null."""
    found = F.array_remove(F.split(ascii_lower(text), BETWEEN), "")
    return F.coalesce(F.transform(found, lambda w: F.xxhash64(w)), F.array().cast("array<long>"))


def _upto(n: Column, f: Callable[[Column], Column], kind: str) -> Column:
    """[f(1), ..., f(n)], empty for n < 1."""
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), f)).otherwise(F.array().cast(f"array<{kind}>"))


def _mark(n: Column, fp: Column, at: Column, near: Column) -> Column:
    return F.struct(n.cast("int").alias("len"), fp.cast("long").alias("fp"), at.cast("int").alias("at"), near.cast("array<long>").alias("near"))


_MARK = "struct<len:int,fp:long,at:int,near:array<long>>"


def _kept(w: Column) -> Column:
    """Marks of the kept hashes: len WINDOW, the hash, the place of the first window, the K-grams of it and the next ones."""
    grams = _upto(F.size(w) - (K - 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(K))), "long")

    def marks(h: Column) -> Column:
        least = _upto(F.size(h) - (W - 1), lambda s: F.array_min(F.slice(h, s, F.lit(W))), "long")

        def chosen(m: Column) -> Column:
            at = F.filter(F.sequence(F.lit(1), F.size(m)), lambda s: (s % W == 1) | (F.get(m, s - 1) != F.get(m, s - 2)))
            return F.transform(at, lambda s: _mark(F.lit(WINDOW), F.get(m, s - 1), s, F.slice(h, s, F.lit(2 * W - 1))))

        return F.when(F.size(h) >= W, let(least, chosen)).otherwise(F.array().cast(f"array<{_MARK}>"))

    return let(grams, marks)


def _short(w: Column, n: int) -> Column:
    """Marks of all n-word windows, for items of n < WINDOW words."""
    return _upto(F.size(w) - (n - 1), lambda i: _mark(F.lit(n), F.xxhash64(F.lit(n), F.slice(w, i, F.lit(n))), i, F.array()), _MARK)


def _windows(marks: DataFrame, *keys: str) -> DataFrame:
    """Marks to the windows around them: keys, start, len, a, b; other marks give one row of nulls."""
    long = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("near") - (W - 1), F.lit(1))),
        lambda j: F.struct((F.col("at") + j - 1).alias("start"), F.get("near", j - 1).alias("a"), F.get("near", j + (W - 2)).alias("b")),
    )
    one = F.array(F.struct(F.col("at").alias("start"), F.col("fp").alias("a"), F.col("len").cast("long").alias("b")))
    ready = F.when(F.col("len") == WINDOW, F.filter(long, lambda x: x["b"].isNotNull())).when(F.col("len") > 0, one)
    out = marks.withColumn("x", F.explode_outer(ready))
    return out.select(*keys, F.when(F.col("len") == 0, F.col("at")).alias("n"), "len", "x.start", "x.a", "x.b")


def benchmark_windows(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """(windows: fp array, a, b, items), the lengths of items shorter than a window. Null ids and items without words are left out."""
    w = items.where("item_id is not null and text is not null").select("item_id", words(F.col("text").cast("string")).alias("w")).where(F.size("w") > 0)
    w = materialize(w.groupBy("w").agg(F.array_sort(F.collect_set("item_id")).alias("ids")).coalesce(PARTS), "items", native=True)
    lengths = sorted(r[0] for r in w.select(F.size("w")).where(F.size("w") < WINDOW).distinct().collect())
    marks = w.select("ids", F.explode(F.when(F.size("w") >= WINDOW, _kept(F.col("w"))).otherwise(
        _by_length(F.col("w"), lengths))).alias("m")).select("ids", "m.*")
    around = _windows(marks.select("*"), "fp", "ids")
    found = around.groupBy("a", "b").agg(F.collect_set("fp").alias("fps"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
    return materialize(found.withColumn("set", F.xxhash64("items")).coalesce(PARTS), "windows", native=True), lengths


def _by_length(w: Column, lengths: list[int]) -> Column:
    out = F.array().cast(f"array<{_MARK}>")
    for n in lengths:
        out = F.when(F.size(w) == n, _short(w, n)).otherwise(out)
    return out


def left_join(rows: DataFrame, to: DataFrame, on: list[str], keys: tuple[str, ...], small: bool) -> DataFrame:
    """rows joined to `to` on columns that are null together: by a broadcast if small, else by a shuffle in which rows without a value
    go to partitions by their keys instead of all to that of null. `to` has no nulls there."""
    if small:
        return rows.join(F.broadcast(to), on, "left")
    own = F.col(on[0]).isNull()
    apart = rows.withColumn("own", own).withColumns({c: F.coalesce(c, F.xxhash64(*keys)) for c in on})
    met = apart.join(to.withColumn("own", F.lit(False)), [*on, "own"], "left")
    return met.withColumns({c: F.when(~F.col("own"), F.col(c)) for c in on}).drop("own")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs (doc_id, text).

    A window is WINDOW consecutive words of an item (item_id, text), or a shorter item's words; a
    document's word inside any occurrence of a window is hit. Texts are whole. Null or empty texts have
    no words: nothing is hit and items_sha256 is that of the empty string. Equal items list all their
    ids; repeated rows of docs stay; null doc_ids are kept apart by text. Other columns are ignored.
    """
    return by_text(docs, items).drop("tk")


def by_text(docs: DataFrame, items: DataFrame) -> DataFrame:
    """decontaminate() with tk, the text_key() of the row: what it says holds for the rows of a doc_id and tk."""
    known, lengths = benchmark_windows(items.select("item_id", "text"))
    prints = known.select(F.explode("fps").alias("fp")).distinct()
    sets = known.select("set", "items").dropDuplicates(["set"])
    few = {"prints": prints.count(), "windows": known.count(), "ids": sets.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]}
    few = {k: n <= BROADCAST_ROWS for k, n in few.items()}
    keys = ("doc_id", "tk")
    text = F.col("text").cast("string")
    # the document's own mark holds its number of words
    marks = let(words(text), lambda w: F.concat(F.array(_mark(F.lit(0), F.lit(None), F.size(w), F.array())), _kept(w), *[_short(w, n) for n in lengths]))
    rows = docs.select("doc_id", text_key().alias("tk"), F.explode(marks).alias("m")).select(*keys, "m.*")
    met = left_join(rows, prints.withColumn("met", F.lit(True)), ["fp"], keys, few["prints"]).where("met or len = 0").drop("met")
    around = _windows(met, *keys)
    to = known.select("a", "b", "set")
    around = left_join(around, to, ["a", "b"], keys, few["windows"])
    hit = F.col("set").isNotNull()
    per = around.groupBy(*keys).agg(
        F.max("n").cast("long").alias("n_words"), F.count("n").alias("copies"),
        F.collect_set(F.when(hit, F.struct("start", "len"))).alias("hits"), F.collect_set("set").alias("sets"),
    )
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1))))
    per = per.select(*keys, "n_words", "copies", F.size(covered).cast("long").alias("n_hit"), F.explode_outer("sets").alias("set"))
    per = left_join(per, sets, ["set"], keys, few["ids"])
    ids = F.array_distinct(F.flatten(F.collect_set("items")))
    out = per.groupBy(*keys).agg(F.first("n_words").alias("n_words"), F.first("copies").alias("copies"), F.first("n_hit").alias("n_hit"), ids.alias("ids"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    named = F.array_join(F.array_sort(F.transform("ids", lambda x: x.cast("string"))), ",")
    return few_files(out, docs.count()).select(
        "doc_id", "tk", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(named.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, win FROM (SELECT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM b)),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM dp) dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
