"""Periodic runs, repeated passages and the filter audit against brute force: nulls, ties, repeats, long texts, hot groups."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsframe.llm import filter_audit, langid, queries, runs, suffix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


# --- 11 ------------------------------------------------------------------------------------------------


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                part = words[i : j + q]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts(seed):
    rng = random.Random(seed)
    out = [None, "", " \n ", "a", "a a a a a", "a a a a a a", "b " * 40, "Ab ab " * 9, "x y z " * 5 + "x y", "ß é " * 8, "a\tb\x0bc\x0cd\re\n" * 6]
    for _ in range(60):
        k = rng.choice([1, 2, 3, 8])
        words = [rng.choice("abcdefgh"[:k]) for _ in range(rng.randint(1, 60))]
        if rng.random() < 0.6:
            p = rng.randint(1, 9)
            words += (words[:p] * 12)[: rng.randint(p, 12 * p)] + [rng.choice("ab") for _ in range(rng.randint(0, 9))]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("long", "unit"), [(runs.LONG, runs.UNIT), (40, 1), (0, 200)])
def test_runs_against_brute_force(spark, long, unit):
    texts = periodic_texts(long % 97)
    rows = [*enumerate(texts), (3, texts[3]), (6, texts[6]), (6, "other " * 7), (None, "n " * 30), (None, "n " * 30), (None, None)]
    docs = documents(spark, rows).withColumn("runs", F.lit("own")).withColumn("key", F.lit(1))
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in runs.periodic_runs(docs, long=long, unit=unit).collect())
    want = Counter()
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        found = brute_runs(words)
        want[i, len(words), tuple(found), brute_collapsed(words, found)] += 1
    assert got == want
    assert runs.periodic_runs(documents(spark, []), long=long, unit=unit).count() == 0


def test_all_lags_are_dealt_once():
    for n, unit in ((6, 1), (1000, 1), (1000, 7000), (5, 9), (100_000, 1 << 24)):
        lags = [q for lo, hi in runs.lag_ranges(n, unit) for q in range(lo, hi)]
        assert lags == list(range(1, n // 4 + 1))


def test_strongest_run_is_exact_and_first(spark):
    rows = [([(0, 8, 2), (20, 12, 3), (40, 9, 2)],), ([(5, 8, 2), (9, 12, 3)],), ([(0, 3 * 10**9 + 1, 3), (7, 10**9, 1)],), ([],)]
    got = spark.createDataFrame(rows, f"runs array<{runs.RUN}>").select(runs.strongest(F.col("runs")).alias("b")).collect()
    assert [r["b"] and tuple(r["b"]) for r in got] == [(40, 9, 2), (5, 8, 2), (0, 3 * 10**9 + 1, 3), None]


def test_planted_words(spark):
    rows = [(i, " ".join(f"w{k % 7}{i}" for k in range(i % 40))) for i in range(200)] + [(None, "a b c"), (3, None), (4, " \t ")]
    for r in documents(spark, rows).select("doc_id", "text", runs.planted(F.col("doc_id"), F.col("text")).alias("new")).collect():
        words = (r["text"] or "").split()
        h = 1 if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert (r["new"] or "").split() == words


# --- 12 ------------------------------------------------------------------------------------------------


def brute_repeats(rows):
    """rows (doc_id, text) in the order that says what is earlier."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - suffix.WIDTH + 1):
            w = b[p : p + suffix.WIDTH]
            if w in seen:
                gone[p : p + suffix.WIDTH] = True
            seen.add(w)
        turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        out.append((i, len(b), int(gone.sum()), tuple(map(tuple, turn.reshape(-1, 2).tolist())), np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()))
    return Counter(out)


def repeated_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, page = prose(18), prose(90)
    out = [None, "", "short", "x" * 99, "x" * 100, "x" * 101, "x" * 700, "ab" * 300, "é" * 50, "é" * 90, "日本" * 40, line, line[1:], page, page, page + "!", "\x00" * 150, (prose(5) + " ") * 30]
    for _ in range(60):
        kind = rng.randrange(4)
        cut = rng.randrange(len(page) // 2)
        out.append([prose(40), prose(9) + line + prose(12), prose(3) + page[cut : cut + rng.randint(90, 400)] + prose(6), line + line[:40] + line + prose(2)][kind])
    return out


@pytest.mark.parametrize(("block", "unit", "hot"), [(suffix.BLOCK, suffix.UNIT, suffix.HOT), (1500, 400, 3), (4000, 1 << 20, 1)])
def test_repeats_against_brute_force(spark, block, unit, hot):
    rows = list(enumerate(repeated_texts(block % 89)))
    docs = documents(spark, rows).orderBy(F.col("doc_id").desc()).withColumn("hash", F.lit("own")).withColumn("g", F.lit(1))
    out = suffix.remove_repeats(docs.repartition(5, "doc_id"), block=block, unit=unit, hot=hot).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], tuple(map(tuple, r["spans"])), bytes(r["kept"])) for r in out) == brute_repeats(rows)


def test_repeats_of_rows_without_ids_of_their_own(spark):
    a, b = "the first passage " * 9 + "a", "another text " * 12 + "b"
    rows = [(None, a), (7, a), (7, a), (5, None), (5, b), (9, b + a), (None, b)]
    out = Counter((r["doc_id"], r["n_bytes"], r["n_bytes"] - r["n_removed"]) for r in suffix.remove_repeats(documents(spark, rows)).collect())
    kept = {t: len(next(iter(brute_repeats([(0, t)])))[4]) for t in (a, b)}
    n = {t: len(t) for t in (a, b)}
    both = next(iter(k[4] for k in brute_repeats([(0, a), (1, b), (9, b + a)]) if k[0] == 9))
    assert out == Counter({(7, n[a], kept[a]): 1, (7, n[a], 0): 1, (None, n[a], 0): 1, (5, 0, 0): 1, (5, n[b], kept[b]): 1, (9, n[a] + n[b], len(both)): 1, (None, n[b], 0): 1})
    assert suffix.remove_repeats(documents(spark, [])).count() == 0
    assert suffix.remove_repeats(documents(spark, [(1, None), (2, "")])).count() == 2


def test_suffix_arrays_by_two_stages():
    for seed in range(150):
        rng = random.Random(seed)
        n, k = rng.randint(0, 300), rng.choice([1, 2, 3, 20])
        t = bytes(97 + rng.randrange(k) for _ in range(n))
        t = (t[:7] * 60)[:n] if seed % 5 == 0 else t
        for depth in (8, 20, 100, 400):
            sa = suffix.suffix_array(np.frombuffer(t, dtype=np.uint8), depth).tolist()
            assert sorted(sa) == list(range(n))
            assert [t[i : i + depth] for i in sa] == [t[i : i + depth] for i in sorted(range(n), key=lambda i: t[i:])]


def test_a_hot_mark_is_split_by_content():
    rng = np.random.default_rng(3)
    line = rng.integers(97, 123, 60).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, 80).astype(np.uint8), line, rng.integers(97, 123, 80).astype(np.uint8)]) for _ in range(300)]
    seg = suffix.Segments(np.concatenate(texts), np.array([len(t) for t in texts]))
    most = Counter(seg.key.tolist()).most_common(1)[0]
    key, at, n = seg.split(np.flatnonzero(seg.key == most[0]))
    assert most[1] > 250 and max(Counter(key.tolist()).values()) < most[1] / 5
    assert sum(n) == sum(seg.n[seg.key == most[0]])


# --- 13 ------------------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    least, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    parts = {}
    for i, t, lang in docs:
        t = t or ""
        words = [w.decode() for w in t.encode().split()]
        fails = {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and least[t] < i else set()
        parts.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out, shares = {}, Counter()
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                removed_before = sum(f in r[0] for r in rows) - len(gone)
                left = [r for r in left if f not in r[0]]
                shares[part, f] += len(gone)
                out[part, "".join(order), k + 1, f] = (len(left), len(gone), removed_before, sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
    return {k: (*v, shares[k[0], k[3]]) for k, v in out.items()}


def test_audit_against_brute_force(spark):
    rng = random.Random(5)
    long = lambda k, n=130: " ".join(rng.choice("abcdefgh") + str(rng.randrange(k)) for _ in range(n))
    texts = [None, "", "A B C", "SHOUT $", long(3), long(9000), long(9000).upper(), long(9000) + " #", "a" * 300, "É ß " * 60, "word word " * 120]
    docs = [(i, rng.choice(texts), rng.choice([None, "", "en", "de"])) for i in range(120)] + [(None, texts[3], "en"), (None, texts[3], "en"), (7, texts[4], "en"), (7, texts[4], "en"), (8, "only once", "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5000, 1, 1)]
    d = spark.createDataFrame([(i, t, lang, 1, "own", True) for i, t, lang in docs], "doc_id long, text string, lang string, A int, part string, first boolean")
    got = filter_audit.audit_documents(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r)[:4]: tuple(r)[4:] for r in got} == brute_audit(docs, labels)
    none = d.limit(0)
    assert filter_audit.audit_documents(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_audit_of_other_filters_and_parts(spark):
    rows = spark.range(60).select((F.col("id") % 3).alias("p"), (F.col("id") % 2 == 0).alias("even"), F.col("id"), F.lit(True).alias("good"), F.lit(None).cast("boolean").alias("toxic"))
    got = filter_audit.audit(rows, {"X": F.col("even"), "Y": F.when(F.col("id") < 30, True)}, ["p"]).where("p = 0").collect()
    assert {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in got} == {
        ("XY", 1): (10, 10, 0, 10, 0, 15), ("XY", 2): (5, 5, 5, 5, 0, 15), ("YX", 1): (10, 10, 0, 10, 0, 15), ("YX", 2): (5, 5, 5, 5, 0, 15)}
    assert len(filter_audit.lattice("ABCDE")) == 80
    with pytest.raises(ValueError):
        filter_audit.audit(rows, {c: F.lit(True) for c in "ABCDEFGH"}, ["p"])


def test_queries_give_the_digests(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", runs.planted(F.col("doc_id"), F.col("text")).alias("t")).collect()
    assert len(got) == len(docs)
    for d in docs[::9]:
        words = [w.decode() for w in (d["t"] or "").encode().split()]
        if len(words) < 400:
            found = brute_runs(words)
            r = got[d["doc_id"]]
            assert r["n_runs"] == len(found) and r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
            assert r["collapsed_sha256"] == hashlib.sha256(brute_collapsed(words, found).encode()).hexdigest()


# --- 2: the mixture against plain loops ------------------------------------------------------------------


def plain_em(p, steps):
    """p: a row of probabilities a trigram."""
    n = len(p[0])
    share = [1 / n] * n
    for _ in range(steps):
        total = [0.0] * n
        for row in p:
            whole = sum(s * x for s, x in zip(share, row, strict=True))
            for k in range(n):
                total[k] += share[k] * row[k] / whole
        share = [t / len(p) for t in total]
    return share, sum(math.log(sum(s * x for s, x in zip(share, row, strict=True))) for row in p)


def plain_languages(model, text):
    """Languages by trying every one that could be added, with the whole likelihood of each set."""
    p = model.p[langid.grams(text)].astype(float)
    every = range(len(model.langs))
    chosen = [max(every, key=lambda k: float(np.log(p[:, k]).sum()))]
    share, value = [1.0], float(np.log(p[:, chosen[0]]).sum())
    while len(chosen) < len(model.langs):
        tried = {k: plain_em(p[:, [*chosen, k]].tolist(), langid.STEPS) for k in every if k not in chosen}
        k = max(tried, key=lambda k: tried[k][1])
        new, best = tried[k]
        if (best - value) / 3 <= 0.5 * langid.PENALTY * math.log(len(p) + 1) or min(new) < langid.LEAST_SHARE:
            break
        chosen, share, value = [*chosen, k], new, best
    return dict(zip([model.langs[k] for k in chosen], share, strict=True))


def test_language_mixtures_against_plain_loops(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null and length(text) > 300").select("text", "lang").orderBy("doc_id").collect()]
    langs = sorted({r["lang"] for r in rows})
    counts = np.zeros((len(langs), langid.BUCKETS))
    for r in rows[::2]:
        counts[langs.index(r["lang"])] += np.bincount(langid.grams(r["text"]), minlength=langid.BUCKETS)
    model, rng, same = langid.Mixture(langs, counts), random.Random(1), 0
    texts = [" ".join(rng.choice(rows[1::2])["text"][:250] for _ in range(k)) for k in (1, 1, 2, 2, 3) for _ in range(6)]
    for text in texts:
        got, want = dict(model.infer(text)), plain_languages(model, text)
        assert max(got, key=lambda k: (got[k], k)) == max(want, key=lambda k: (want[k], k)) or len(got) != len(want)
        if set(got) == set(want):
            same += 1
            assert all(abs(got[k] - want[k]) < 1e-3 for k in got)
    # one step of a slope chooses which language to try; trying all of them hardly ever says otherwise
    assert same >= len(texts) - 2 and any(len(model.infer(t)) > 1 for t in texts)


def test_equal_languages_go_to_the_first_name_and_repeats_stay(spark):
    rows = [(1, "uno due tre quattro", "b"), (2, "uno due tre quattro", "a"), (2, "uno due tre quattro", "a"), (None, "uno due tre", None), (None, "uno due tre", None), (3, None, "a"), (4, "12 34", "b")]
    docs = spark.createDataFrame([(i, t, k, "own", 1) for i, t, k in rows], "doc_id long, text string, lang string, lang_pred string, score int")
    got = Counter((r["doc_id"], r["lang_pred"]) for r in langid.detect(docs, langid.fit(docs)).collect())
    assert got == Counter([(1, "a"), (2, "a"), (2, "a"), (None, "a"), (None, "a"), (3, "und"), (4, "und")])
