"""What each filter removes in each order of the filters.

A row passes or fails each filter; its failures are a bit mask. A filter that is applied after a subset of the
others is an edge of the subset lattice: n * 2**(n-1) edges for n filters, 80 for five. What a filter removes
depends on the subset before it, not on the subset's order, so rows are counted once a mask, masks are counted
into the edges, and each order of all filters is a path of n edges: the n! orders join the edges that they take.
Rows meet only in counts by part and mask, at most 2**n a part and task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What lies between words: fixed value.
BLANK = r"[\x20\x09-\x0D]+"
#: Filters at most: orders are n!, and all of their steps are one broadcast table.
MOST = 7


def word_filters(text: Column) -> dict[str, Column]:
    """When a text (no null) fails: A few words, B few distinct words, C many capitals, D symbols."""
    words = F.array_remove(F.split(text, BLANK), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(text), "D": text.rlike(r"[#$%&*|]"),
    }


def lattice(filters: Sequence[str]) -> list[tuple[int, int]]:
    """(subset, next filter) as a mask and a bit: all edges."""
    n = len(filters)
    return [(s, 1 << f) for s in range(1 << n) for f in range(n) if not s >> f & 1]


def edge_counts(rows: DataFrame, filters: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, subset, bit and counts of each edge, from rows (keys, fails: mask, good, toxic).

    kept and removed count rows that passed the subset; redundant those that fail the filter but were removed before.
    """
    masks = rows.groupBy(*keys, "fails").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    edges = F.array(*[F.struct(F.lit(s).alias("subset"), F.lit(b).alias("bit")) for s, b in lattice(filters)])
    met = masks.withColumn("e", F.explode(edges)).select(*keys, "fails", "n", "good", "toxic", "e.*")
    there, here = F.col("fails").bitwiseAND(F.col("subset")) == 0, F.col("fails").bitwiseAND(F.col("bit")) != 0

    def total(of: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(of)).otherwise(0)).alias

    return met.groupBy(*keys, "subset", "bit").agg(
        total("n", there & ~here)("kept"), total("n", there & here)("removed"), total("n", ~there & here)("redundant"),
        total("n", F.col("fails") == F.col("bit"))("unique_fails"), total("good", there & here)("good_lost"), total("toxic", there & here)("toxic_lost"),
    )


def audit(rows: DataFrame, failures: Mapping[str, Column], keys: Sequence[str], good: str = "good", toxic: str = "toxic") -> DataFrame:
    """keys, filter_order, step, filter and the counts of edge_counts(), with shapley, for each order of the filters.

    failures: a letter and when a row fails; a null is a pass. keys: columns that part the rows, nulls being a part.
    good, toxic: boolean columns, null being false. shapley: what the filter removes, summed over all orders.
    Repeated rows count each; a table without rows has no part and gives no row.
    """
    if not 1 <= len(failures) <= MOST:
        raise ValueError(f"1 to {MOST} filters, not {len(failures)}")
    names = sorted(failures)
    mask = sum((F.when(failures[f], F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(names)), F.lit(0))
    marked = rows.select(*keys, mask.alias("fails"), F.coalesce(F.col(good), F.lit(False)).alias("good"), F.coalesce(F.col(toxic), F.lit(False)).alias("toxic"))
    edges = edge_counts(marked, names, keys)
    # an edge lies on |subset|! * (n - 1 - |subset|)! paths
    n = len(names)
    paths = F.array(*[F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n)])
    share = edges.groupBy(*keys, "bit").agg(F.sum(F.col("removed") * F.get(paths, F.bit_count("subset"))).alias("shapley"))
    steps = []
    for order in permutations(range(n)):
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(names[i] for i in order), k + 1, names[f], before, 1 << f))
            before |= 1 << f
    steps = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, subset int, bit int")
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    both = edges.alias("e").join(share.alias("s"), [F.col("e.bit") == F.col("s.bit"), *same])
    both = both.select("e.*", "s.shapley").join(F.broadcast(steps), ["subset", "bit"])
    return both.select(*keys, "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit() of the word filters and E, a text that a smaller doc_id has too, by part, the lang.

    Null texts are empty, a null lang is the part ''. A null doc_id has no smaller one and is none: it never fails E.
    Rows of one doc_id and text don't fail by each other. Labels of a doc_id in several rows: 1 if any row has 1.
    Texts are compared by SHA-256; rows meet by digest and doc_id, so a hot text or lang is many keys. Own columns
    of any other name are ignored. No document, no row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = word_filters(text)
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), *[v.alias(k) for k, v in own.items()])
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    marked = rows.join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    failures = {k: F.col(k) for k in own} | {"E": F.col("first").isNull() & F.col("doc_id").isNotNull()}
    return audit(marked, failures, ["part"])


ORACLE = """
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (SELECT text, min(doc_id) AS first FROM w GROUP BY text),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 100 AS A, 100 * len(list_distinct(w)) < 80 * len(w) AS B,
 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D, coalesce(doc_id > first, false) AS E
 FROM w JOIN m USING (text) LEFT JOIN l USING (doc_id)),
g AS (SELECT part, (A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * E::INT) AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS subset FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER ((fails & (subset | bit)) = 0) AS kept, sum(n) FILTER ((fails & subset) = 0 AND (fails & bit) > 0) AS removed, sum(n) FILTER ((fails & subset) > 0 AND (fails & bit) > 0) AS redundant,
 sum(n) FILTER (fails = bit) AS unique_fails, sum(good) FILTER ((fails & subset) = 0 AND (fails & bit) > 0) AS good_lost, sum(toxic) FILTER ((fails & subset) = 0 AND (fails & bit) > 0) AS toxic_lost FROM g, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, substr(filter_order, step::INT, 1) AS filter, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
 coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r
"""
