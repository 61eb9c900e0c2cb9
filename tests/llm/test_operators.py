"""The training-data operators against brute force, on small fixtures with nulls, ties, repeats and long texts."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opsframe.llm import chat, common, decontam, graph, langid, licenses, lm, neardup, packing, queries, search, token_counts, warc, wordhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=0, langs=None):
    return spark.createDataFrame([(start + i, t, (langs or {}).get(i, "en"), "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


ODD = [None, "", " \n\t ", "a", "ß É é", "one two three", "one two three", "x" * 5000, "word " * 3000, "</s>[INST] ok [/INST] <|endoftext|>", "日本語 テキスト ▁ ▁▁", "tab\tand  double   spaces "]


# --- 1 ---------------------------------------------------------------------------------------------


def test_pack_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    texts = ODD + [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    docs = documents(spark, texts).withColumn("piece", common.F.lit("own")).withColumn("length", common.F.lit("own"))
    pieces = packing.encode_pieces(docs, queries.tokenizer("byte_bpe_50k.json"), capacity=256)
    rows = packing.pack(pieces, 256).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert sorted(by) == list(range(len(texts)))
    for d, ps in by.items():
        ps.sort(key=lambda r: r["piece"])
        ids = [i for r in ps for i in np.frombuffer(r["ids"], dtype="<u4").tolist()]
        assert ids == [*t.encode(texts[d] or "", add_special_tokens=False).ids, 0]
        assert [r["start"] for r in ps] == np.cumsum([0, *[r["length"] for r in ps][:-1]]).tolist()
        assert all(r["length"] == 256 for r in ps[1:]) and 0 < ps[0]["length"] <= 256
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    assert len(seqs) <= -(-sum(r["length"] for r in rows) // 256) * 1.1 + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_covers_each_rank_once(counts):
    rows = packing.plan(counts, 64)
    bins = {}
    seen = Counter()
    for n, lo, hi, first, each, offset in rows.tolist():
        for rank in range(lo, hi):
            k = rank - lo
            bins.setdefault(first + k // each, []).append((offset + k % each * n, n))
            seen[n] += 1
    assert seen == Counter(counts)
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64 and sum(3 * n > 64 for _, n in b) <= 2
    assert sorted(bins) == list(range(len(bins)))


def test_pack_of_nothing(spark):
    assert packing.pack(packing.encode_pieces(empty(spark), queries.tokenizer("byte_bpe_50k.json"))).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------


def test_language_accuracy_on_held_out(spark):
    rows = queries.op2_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and held
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_mixture_and_edges(spark):
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zxqv", "wkjh", "yyfg"]}
    rng = random.Random(1)
    make = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    train = documents(spark, [make(k, 60) for k in ("aa", "bb") * 20], langs={i: ("aa", "bb")[i % 2] for i in range(40)})
    model = langid.fit(train)
    got = dict(model.infer(make("aa", 150) + " " + make("bb", 50)))
    assert set(got) == {"aa", "bb"} and 0.6 < got["aa"] < 0.9
    out = langid.detect(documents(spark, [None, "", "123 !?", make("bb", 9), make("bb", 60000)]).withColumn("score", common.F.lit("own")), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in out] == ["und", "und", "und", "bb", "bb"] and out[0]["score"] == 0
    nothing = langid.fit(empty(spark))
    assert langid.detect(documents(spark, ["abc"]), nothing).first()["lang_pred"] == "und"
    assert langid.detect(empty(spark), model).count() == 0


def test_language_sample_is_bounded_and_counts_copies_once(spark, monkeypatch):
    monkeypatch.setattr(langid, "Mixture", lambda langs, counts: counts)
    texts = [f"text{i:03}" for i in range(120)]
    once = langid.fit(documents(spark, texts))
    assert (langid.fit(documents(spark, texts + [texts[5]] * 300)) == once).all() and once.sum() == 120 * len(langid.grams(texts[0]))
    monkeypatch.setattr(langid, "TRAIN_DOCS", 10)
    got = langid.fit(documents(spark, texts * 3, langs={i: ("aa", "bb")[i % 2] for i in range(120)}))
    assert got.shape[0] == 3 and (got.sum(axis=1) == 10 * len(langid.grams(texts[0]))).all()


# --- 3 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard", [8192, 37])
def test_search_is_exact(spark, monkeypatch, shard):
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()][:150] + [None, "", "the", "the", "zzz"]
    docs = documents(spark, texts)
    asked = [(i, texts[i]) for i in (0, 7, 50, 150, 151, 152)]
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "COMMON", shard // 8)
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "TASK_QUERIES", 2)
    got = search.search(docs, spark.createDataFrame(asked, "query_id long, text string"), k=5)
    got = sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in got.collect())
    want = [(q, r, d, round(s, 6)) for q, r, d, s in search.brute_force(list(enumerate(texts)), asked, 5)]
    assert got == want


def test_search_of_odd_rows(spark):
    texts = ["a b c", "a b c", "a b", None, "", "b " * 50_000 + "q", "c q"] + [f"a w{i}" for i in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "a b c"), (None, "a b c"), (40, "a b c")]
    docs = spark.createDataFrame([(i, t, "own", "own") for i, t in rows], "doc_id long, text string, rank string, score string")
    asked = [(7, "a b c"), (7, "a b c"), (None, "a"), (8, None), (9, "q " * 30_000)]
    got = search.search(docs, spark.createDataFrame([(i, t, "own") for i, t in asked], "query_id long, text string, rank string"), k=6)
    got = sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in got.collect())
    assert got == [(q, r, d, round(s, 6)) for q, r, d, s in search.brute_force([r for r in rows if r[0] is not None], [(7, "a b c"), (9, asked[4][1])], 6)]
    assert [d for q, _, d, _ in got if q == 7][:4] == [0, 1, 1, 40]


def test_search_skips_postings():
    rng = random.Random(2)
    texts = [" ".join(rng.choices([f"{'xyz'[i % 3]}{j}" for j in range(300)], k=rng.choice([5, 30]))) for i in range(3000)]
    bags, n = search.bags(texts), len(texts)
    average = sum(int(c.sum()) for _, c in bags) / n
    df = Counter(t for b, _ in bags for t in b.tolist())
    asked = [(t, np.array([c * math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) for x, c in zip(t.tolist(), k.tolist(), strict=True)])) for t, k in bags[:60]]
    shard = search.Shard(search.Shard.arrays(list(range(n)), bags, average, 8), 8, 20)
    got = shard.best(asked, 5, np.zeros(60))
    want = search.brute_force(list(enumerate(texts)), list(enumerate(texts[:60])), 5)
    assert [(q, int(d), round(float(s), 6)) for q, (ds, ss) in enumerate(got) for d, s in zip(ds, ss, strict=True)] == [(q, d, round(s, 6)) for q, _, d, s in want]
    assert shard.skipped > shard.scored > 0
    before = shard.scored
    again = shard.best(asked, 5, np.array([s[-1] for _, s in got]))
    assert all((a[0] == b[0]).all() for a, b in zip(got, again, strict=True)) and shard.scored - before <= before


def test_search_tiles_are_of_a_block():
    """Each language's frequent words are dense in its own blocks, so none of their postings is read one by one."""
    texts = [" ".join(["xyz"[i // 16]] * 9 + [f"{'xyz'[i // 16]}{2 * j + (i >> j & 1)}" for j in range(4)]) for i in range(48)]
    bags = search.bags(texts)
    df = Counter(t for b, _ in bags for t in b.tolist())
    asked = [(t, np.array([c * math.log(1 + (48 - df[x] + 0.5) / (df[x] + 0.5)) for x, c in zip(t.tolist(), k.tolist(), strict=True)])) for t, k in bags]
    shard = search.Shard(search.Shard.arrays(list(range(48)), bags, 13, 16), 16, 9)
    got = shard.best(asked, 3, np.zeros(48))
    want = search.brute_force(list(enumerate(texts)), list(enumerate(texts)), 3)
    assert [(q, int(d), round(float(s), 6)) for q, (ds, ss) in enumerate(got) for d, s in zip(ds, ss, strict=True)] == [(q, d, round(s, 6)) for q, _, d, s in want]
    assert shard.scored == 0


def test_search_of_nothing(spark):
    q = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    assert search.search(empty(spark), q).count() == 0
    assert search.search(documents(spark, ["a"]), q.limit(0)).count() == 0


# --- 4 ---------------------------------------------------------------------------------------------


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"][0]
    gpl = licenses.TEMPLATES["GPL-3.0"][1]
    filler = "some other words about the version of a license and the software " * 40
    texts = [None, "", "no notice here", mit, f"{filler}{mit} {mit} {filler}", gpl.replace("redistribute", "share").upper(), "license " * 50, filler + gpl]
    out = licenses.scan_licenses(documents(spark, texts)).orderBy("doc_id").collect()
    assert [r["license_id"] for r in out] == [None, None, None, "MIT", "MIT", "GPL-3.0", None, "GPL-3.0"]
    assert out[3]["coverage"] == 1.0 and (out[3]["start_word"], out[3]["end_word"]) == (0, 5)
    assert 0.9 < out[5]["coverage"] < 1
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_license_scan_skips_no_covered_notice():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.LEAST_COVERAGE)
    found = lambda text: {x[0] for x in scanner.scan(text)}
    assert "MIT" in found(licenses.TEMPLATES["MIT"][1].replace("any person obtaining a copy ", ""))
    assert "BSD-3-Clause" in found(licenses.TEMPLATES["BSD-3-Clause"][0].replace("binary forms, with or ", ""))
    for name, notices in licenses.TEMPLATES.items():
        for t in map(licenses.words, notices):
            for lo in range(len(t)):
                for hi in range(lo + 1, min(len(t), lo + 10) + 1):
                    w = t[:lo] + t[hi:]
                    assert name in found(" ".join(w)) or len(licenses.patience(w, t)) < licenses.LEAST_COVERAGE * len(t)


class Unfiltered(licenses.Scanner):
    """Aligns every stretch of a text, without a filter: starts at each word, ends after one and two lengths of a notice."""

    def covered(self, text):
        w = licenses.words(text)
        return {name for name, t, _ in self.all for lo in range(len(w)) for n in (len(t), 2 * len(t)) if len(licenses.patience(w[lo : lo + n], t)) >= self.least * len(t)}


def aligned(text, template, ties):
    """Patience alignment word by word, without work lists: common ends, then the longest chain of words unique to both sides, then the gaps."""
    if not text or not template:
        return []
    if text[0] == template[0]:
        return [(0, 0), *[(a + 1, b + 1) for a, b in aligned(text[1:], template[1:], ties)]]
    if text[-1] == template[-1]:
        return [*aligned(text[:-1], template[:-1], ties), (len(text) - 1, len(template) - 1)]
    pairs = [(i, template.index(x)) for i, x in enumerate(text) if text.count(x) == 1 and template.count(x) == 1]
    chains = []  # all chains that are the longest ones to their last pair
    for i, (_, y) in enumerate(pairs):
        to = [[*c, i] for c in chains if pairs[c[-1]][1] < y] or [[i]]
        chains += [c for c in to if len(c) == max(map(len, to))]
    longest = [c for c in chains if len(c) == max(map(len, chains))]
    if not longest:
        return []
    if len(longest) > 1:
        ties.append(longest)
    chain = [pairs[i] for i in longest[0]]
    out, ends = [], [(-1, -1), *chain, (len(text), len(template))]
    for (a, c), (b, d) in zip(ends, ends[1:], strict=False):
        out += [(a + 1 + i, c + 1 + j) for i, j in aligned(text[a + 1 : b], template[c + 1 : d], ties)] + ([(b, d)] if (b, d) != ends[-1] else [])
    return out


def test_patience_against_a_plain_recursion():
    rng = random.Random(8)
    alike = 0
    for _ in range(600):
        k = rng.choice([2, 5, 12, 30])
        a, b = ([f"w{rng.randrange(k)}" for _ in range(rng.randrange(14))] for _ in range(2))
        if rng.random() < 0.5:
            b = [x for x in a if rng.random() < 0.8] + b[:2]
        got, want = licenses.patience(a, b), aligned(a, b, ties := [])
        assert all(a[i] == b[j] for i, j in got) and got == sorted(got) and all(x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        assert ties or got == want  # of chains of one length either may be taken
        alike += not ties
    assert alike > 300
    assert licenses.patience(list("abcdef"), list("abxdef")) == [(0, 0), (1, 1), (3, 3), (4, 4), (5, 5)]


def test_license_scan_against_all_regions():
    rng = random.Random(6)
    some = {k: [v[0]] for k, v in licenses.FULL_TEXTS.items() if k in ("MPL-2.0", "CC-BY-4.0", "CC0-1.0", "Unlicense")}
    fast, slow = licenses.Scanner(some, 0.8), Unfiltered(some, 0.8)
    for _ in range(120):
        w = licenses.words(rng.choice(list(some.values()))[0])
        keep = rng.choice([0.75, 0.8, 0.82, 0.85, 0.95])
        w = [x for x in w if rng.random() < keep]
        w = [rng.choice(["the", "license", "of", "plain"]) for _ in range(rng.randrange(30))] + w + [rng.choice(["software", "words", "public"]) for _ in range(rng.randrange(30))]
        text = " ".join(w * rng.choice([1, 1, 2]))
        found = {x[0] for x in fast.scan(text)}
        assert found == slow.covered(text)


def test_license_scan_tells_full_texts_apart(spark):
    rows = [(i, k, v[0]) for i, (k, v) in enumerate(sorted(licenses.FULL_TEXTS.items()))]
    long = "license software the of and " * 30_000
    more = [(None, "MIT", licenses.FULL_TEXTS["MIT"][0]), (0, "MIT", licenses.FULL_TEXTS["MIT"][0]), (0, "MIT", licenses.FULL_TEXTS["MIT"][0]), (90, "ISC", long + licenses.FULL_TEXTS["ISC"][0] + long)]
    docs = spark.createDataFrame([(i, t, k, 9.0) for i, k, t in rows + more], "doc_id long, text string, license_id string, coverage double")
    got = Counter((r["doc_id"], r["license_id"], r["coverage"]) for r in licenses.scan_licenses(docs).collect())
    assert got == Counter((i, k, 1.0) for i, k, _ in rows + more)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=12), st.lists(st.sampled_from("abcdef"), max_size=12))
def test_patience_is_an_alignment(a, b):
    got = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    if a == b:
        assert len(got) == len(a)


# --- 5 ---------------------------------------------------------------------------------------------


def digest(turns):
    h = hashlib.sha256()
    for role, text in turns:
        h.update(f"{role or ''}\n{text or ''}\n".encode())
    return h.hexdigest()


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "</s>"), (1, 0, "user", None), (1, 2, None, "x\\<s>"), (2, 0, "assistant", "[INST] <\\s> <<SYS>>\n"), (2, 0, "assistant", "[INST] <\\s> <<SYS>>\n"), (None, None, "ro\nle%", "</s>\n<s>user\n"), (3, 0, "assistant", "y" * 100000)]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", common.F.lit("own")))).collect()}
    assert len(got) == 4
    one = [("user", ""), ("assistant", "</s>"), ("", "x\\<s>")]
    assert got[1]["turns_sha256"] == digest(one) and got[1]["n_turns"] == 3
    assert got[1]["loss_chars"] == 4 and got[1]["loss_sha256"] == hashlib.sha256(b"</s>").hexdigest()
    assert got[2]["n_turns"] == 2 and got[2]["loss_sha256"] == hashlib.sha256(b"[INST] <\\s> <<SYS>>\n" * 2).hexdigest()
    assert got[None]["turns_sha256"] == digest([("ro\nle%", "</s>\n<s>user\n")]) and got[None]["loss_chars"] == 0
    assert got[3]["loss_chars"] == 100000
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_chat_read_back_after_a_write(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"text {c} {t} " * 30) for c in range(40) for t in range(9)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    stored = common.materialize(made, "segments", native=True).repartition(7)
    straight = {tuple(r) for r in chat.read_back(made, ordered=True).collect()}
    assert {tuple(r) for r in chat.read_back(stored).collect()} == straight and len(straight) == 40


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROL, "<", "\\", "s>", "/", "[", "INST]", "a", "|", "<<"]), max_size=12).map("".join))
def test_escape_is_reversible(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)


def test_chat_parts(spark):
    parts = '[{"type":"text","text":"see <|image|>"},{"type":"image","ref":"a.png","width":28,"height":15},{"type":"audio","ref":"b.wav","seconds":2},{"type":"document","ref":"c.pdf","pages":3}]'
    d = spark.createDataFrame([(1, 0, "user", "", parts), (1, 1, "assistant", "ok", None)], "conv_id long, turn long, role string, text string, parts string")
    r = chat.format_conversations(d, parts_col="parts").orderBy("segment").collect()
    assert [(a["kind"], a["ref"], a["position"], a["tokens"]) for a in r[0]["attachments"]] == [("image", "a.png", 0, 4), ("audio", "b.wav", 1, 50), ("document", "c.pdf", 2, 1536)]
    whole = r[0]["text"] + r[1]["text"]
    assert all(whole[a["char_at"] :].startswith(chat.PLACEHOLDERS[a["kind"]]) for a in r[0]["attachments"])
    assert r[0]["expanded_tokens"] == 1590 and whole[r[1]["loss_start"] :][: r[1]["loss_len"]] == "ok"


# --- 6 ---------------------------------------------------------------------------------------------


def brute_decontam(texts, items):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            v = words(x)
            n = min(10, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add(i)
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()))
    return out


def test_rows_without_a_window_are_spread(spark):
    """In joins by shuffle the rows without a value, most of all, are not one partition's."""
    F, was = common.F, {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    rows = spark.range(4000).selectExpr("id AS doc_id", "id AS tk", "IF(id % 100 = 0, id, NULL) AS a", "IF(id % 100 = 0, id, NULL) AS b")
    to = spark.range(0, 4000, 200).selectExpr("id AS a", "id AS b", "id AS set")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = decontam.left_join(rows, to, ["a", "b"], ("doc_id", "tk"), False).withColumn("p", F.spark_partition_id())
        parts = [r["count"] for r in out.groupBy("p").count().collect()]
        assert len(parts) > 4 and max(parts) < 1000
        got = sorted(map(tuple, out.select("doc_id", "a", "b", "set").collect()), key=str)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == sorted(map(tuple, decontam.left_join(rows, to, ["a", "b"], ("doc_id", "tk"), True).select("doc_id", "a", "b", "set").collect()), key=str)


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_decontaminate(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", broadcast)
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "É", "delta9", "eps"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, line(30)), (2, line(12)), (11, "beta gamma"), (3, "same " * 15), (4, None), (5, "!!"), (6, line(9)), (7, line(12)), (8, "solo"), (10, line(10))]
    items.append((9, items[0][1]))
    texts = [None, "", "?", line(400), items[0][1], "x, " + items[1][1] + "; y", "same " * 40, items[6][1].upper(), "BETA... gamma", "solo", line(9), " ".join(items[0][1].split()[3:14]), line(60000)]
    texts.append(texts[4])
    got = decontam.decontaminate(documents(spark, texts).withColumn("n", common.F.lit("own")), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got.collect()}
    assert [got[i] for i in range(len(texts))] == brute_decontam(texts, items)
    twice = documents(spark, texts[:5]).union(documents(spark, texts[:5]))
    assert decontam.decontaminate(twice, spark.createDataFrame(items, "item_id long, text string")).count() == 10
    assert decontam.decontaminate(documents(spark, texts[:5]), spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0
    assert decontam.decontaminate(empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------


def brute_groups(texts, width=2):
    def sh(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    sets = [sh(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]

    def edit(k):
        w = list(base)
        for _ in range(k):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        return " ".join(w)

    common_line = " ".join(f"c{i}" for i in range(60))
    texts = [None, "", "a", "A", "a b", "a b c", "b a"] + [edit(k) for k in range(18) for _ in range(12)]
    texts += [common_line + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([5, 10, 40]))) for _ in range(60)]
    texts += [" ".join(rng.choice("pqrst") for _ in range(rng.randrange(1, 9))) for _ in range(60)] + [edit(0)] * 30
    got = neardup.near_duplicates(documents(spark, texts).withColumn("n", common.F.lit("own")), width).collect()
    by = {r["doc_id"]: r for r in got}
    assert [(by[i]["n_shingles"], by[i]["component_id"]) for i in range(len(texts))] == brute_groups(texts, width)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_a_template_make_few_pairs(spark, monkeypatch):
    rng, met = random.Random(9), []
    shared = [f"t{i}" for i in range(170)]
    texts = [" ".join(shared + [f"o{i}x{j}" for j in range(30)]) for i in range(2000)]
    # two that are linked, and pages whose own words are those of others too
    texts += [texts[7] + " more", texts[8] + " more words"] + [" ".join(shared + [f"p{rng.randrange(40)}" for _ in range(rng.randrange(20, 40))]) for _ in range(150)]
    linked = neardup._linked
    monkeypatch.setattr(neardup, "_linked", lambda pairs, *more: (met.append(pairs.count()), linked(pairs, *more))[1])
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert [got[i] for i in range(2002)] == [*range(2000), 7, 8] and sum(met) <= 3 * len(texts)
    late = range(2002, 2152)
    want = brute_groups([texts[i] for i in late], 5)
    assert [got[i] for i in late] == [late[g] for _, g in want]


def test_near_duplicates_of_hot_values(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[: rng.randrange(70, 100)] + [f"e{rng.randrange(30)}" for _ in range(rng.randrange(8))]) for _ in range(150)]
    monkeypatch.setattr(neardup, "HOT", 3)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(documents(spark, texts), 2).collect()}
    assert [got[i] for i in range(len(texts))] == [g for _, g in brute_groups(texts)]


def test_near_duplicates_edges(spark):
    rows = [(5, "x y z"), (5, "x y z"), (None, "x y z"), (4, "x y z"), (6, None)]
    got = neardup.near_duplicates(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("4", "4", True), ("5", "4", False), ("5", "4", False), ("6", "6", True), ("None", "None", True)]
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_components_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "LEAST_HEAVY", 4)
    edges = [(0, i) for i in range(1, 60)] + [(1000, i) for i in range(100, 160)] + [(59, 1000)] + [(500, 501)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in [*range(1, 60), *range(100, 160), 1000]} | {501: 500}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {100: 90, 95: 90}


def test_lists_across_batches(spark, monkeypatch):
    monkeypatch.setattr(common, "BATCH_ROWS", 3)
    common.small_batches(spark)
    # a value's lowest bit: not early; node i has value v late if i is odd; value 8 is early in no node, value 7 is hot
    hot = lambda v: neardup.HOT << 56 if v == 7 else 0
    late = lambda i, v: i % 2 == 1 or v == 8
    nodes = spark.createDataFrame([(i, [(hot(v) + v) * 2 + late(i, v) for v in range(9) if i % (v + 1) == 0]) for i in range(40)], "doc_id long, kept array<long>")
    got = sorted(map(tuple, neardup._lists(nodes, 40).collect()), key=str)
    want = []
    for v in range(7):
        have = sorted([i for i in range(40) if i % (v + 1) == 0], key=lambda i: (late(i, v), i))
        want += [(v, i, have[0], not late(i, v)) for i in have] if len(have) > neardup.SMALL else [(None, a, b, True) for k, a in enumerate(have) if not late(a, v) for b in have[k + 1 :]]
    dealt = [r for r in got if r[0] == hot(7) + 7]
    assert sorted((r[1], r[3]) for r in dealt) == [(i, not late(i, 7)) for i in range(40) if i % 8 == 0]
    got = [r for r in got if r not in dealt]
    monkeypatch.undo()
    common.small_batches(spark)
    assert got == sorted(want, key=str)


def test_word_hashes():
    texts = [None, "", "A b", "a  B\n", "É É", "x" * (1 << 21), "a b"]
    h = wordhash.word_hashes(texts)
    assert [len(x) for x in h] == [0, 0, 2, 2, 2, 1, 2]
    assert h[2].tolist() == h[3].tolist() == h[6].tolist() and h[4][0] == h[4][1]


# --- 8 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast", [1 << 19, 2, 0])
def test_warc_of_several_bundles_and_frames(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast or 1)
    rng = random.Random(8)
    html = [None, "", "same", "again é"] * 60 + ["".join(rng.choices("abcdefghij<>", k=rng.randrange(900))) for _ in range(300)]
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(html)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), frame_bytes=3000, bundle_bytes=20_000)
    assert index.select("bundle").distinct().count() >= 3 and index.groupBy("bundle", "frame").count().where("count > 2").count() > 5
    back = {r["page_id"]: r for r in warc.read_archives(index).collect()}
    first = {}
    for p, _, h in rows:
        f = first.setdefault(h or "", p)
        r = back[p]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if f == p else ("revisit", f))
        assert r["payload_digest"] == warc.digest_of((h or "").encode()) and (f != p or bytes(r["payload"]) == (h or "").encode())
    assert len(back) == len(rows)


def test_warc_round_trip(spark):
    html = [None, "", "<p>é</p>", "<p>é</p>", "x" * 600_000, "a\r\n\r\nb", "<p>é</p>"]
    rows = [(10 - i, f"http://h/{i} \n", h) for i, h in enumerate(html)] + [(4, "http://again", "<p>é</p>"), (None, None, "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", common.F.lit("own"))
    index = warc.write_archives(d)
    back = {(r["page_id"], r["url"]): r for r in warc.read_archives(index).collect()}
    assert len(back) == len(rows)
    for p, u, h in rows:
        r, body = back[(p, "".join((u or "").split()))], (h or "").encode()
        same = [q for q, _, x in rows if (x or "") == (h or "") and q is not None]
        again = p is not None and p > min(same)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(body), warc.digest_of(body), "revisit" if again else "response", min(same) if again else None)
        assert bytes(r["payload"]) == (b"" if again else body)
    one = index.where("page_id = 6").first()
    reader = warc.BundleReader(one["bundle"])
    assert warc.parse(reader.read(one["frame"], one["offset"], one["length"]))["body"] == b"x" * 600_000
    assert warc.read_archives(warc.write_archives(d.limit(0))).count() == 0
    small = warc.read_archives(warc.write_archives(d, min_payload=5)).where("record_type = 'revisit'")
    assert sorted(r["page_id"] for r in small.collect()) == [7, 8]


# --- 9 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("order", "least"), [(2, 1), (3, 1), (3, 2), (4, 2)])
def test_lm_scores(spark, order, least):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()][:80]
    train = texts[: len(texts) * 3 // 4] + texts[20:30]
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for t in train for w in tok(t))
    n, v = sum(c.values()), len(c)
    grams = {j: Counter(tuple(x[k : k + j]) for t in train for x in [["<s>", *tok(t)]] for k in range(len(x) - j + 1)) for j in range(2, order + 1)}
    sums, kept, discount = {}, {}, {}
    for j, g in grams.items():
        n1, n2 = (sum(x == k for x in g.values()) for k in (1, 2))
        discount[j], sums[j], kept[j] = n1 / (n1 + 2 * n2), Counter(), {}
        for x, k in g.items():
            sums[j][x[:-1]] += k
            if k >= (least if j > 2 else 1):
                kept[j].setdefault(x[:-1], Counter())[x[-1]] = k
    documents_ = documents(spark, train).drop("doc_id").withColumn("doc_id", common.F.lit(None).cast("long"))
    model = lm.train_model(documents_, order=order, least_count=least)
    assert model.tokens == n and model.n == v
    got = lm.score(documents(spark, texts).withColumn("score", common.F.lit("own")), model).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        base = [math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t)]
        full, x = [], ["<s>", *tok(t)]
        for i, b in enumerate(base, 1):
            p = 10**b
            for j in range(2, min(order, i + 1) + 1):
                context = tuple(x[i - j + 1 : i])
                if (more := kept[j].get(context)) and (j == 2 or context[-1] in kept[j - 1].get(context[:-1], ())):
                    total, d = sums[j][context], discount[j]
                    p = max(more[x[i]] - d, 0) / total + (total - sum(more.values()) + d * len(more)) / total * p
            full.append(math.log10(p))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(base), sum(c[w] > 0 for w in tok(t)), n)
        assert r["base_score"] == pytest.approx(sum(base), rel=1e-9)
        assert r["score"] == pytest.approx(sum(full), rel=0.02, abs=0.3)


def test_lm_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "own", 7) for i, t in rows], "doc_id long, text string, n_tokens string, train_tokens int")
    out = lm.score(docs, lm.train_model(docs)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows)
    assert len({r["score"] for r in out if r["n_tokens"] == 4}) == 1 and {r["train_tokens"] for r in out} == {14}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=9), min_size=1, max_size=6), st.integers(2, 4))
def test_lm_tries(texts, order):
    w = np.array([x for t in texts for x in [*t, 7]], dtype=np.uint64)
    pairs, more = lm.windows(w, np.array([len(t) + 1 for t in texts]), 8, 9, order)
    halves = [lm.Tries.of(pairs[k::2], [m[k::2] for m in more]) for k in (0, 1)]
    t = lm.Tries.merge([lm.Tries.load(h.dump(), order) for h in halves if len(h.pairs)])
    want = [Counter(tuple(x[k : k + j]) for s in texts for x in [[8, *s, 7]] for k in range(len(x) - j + 1)) for j in range(2, order + 1)]
    names = None
    for (context, word, c), g in zip(t.lengths(9), want, strict=True):
        names = [((int(a),) if names is None else names[int(a)]) + (int(b),) for a, b in zip(context, word, strict=True)]
        assert dict(zip(names, c.tolist(), strict=True)) == g and names == sorted(names)
    cut = [t.cut(lo, hi).rows() for lo, hi in ((0, min(2, len(t.pairs))), (min(2, len(t.pairs)), len(t.pairs)))]
    assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*[(c[0], *c[1], c[2]) for c in cut], strict=True), (t.rows()[0], *t.rows()[1], t.counts), strict=True))


def test_lm_of_nothing(spark):
    r = lm.score(documents(spark, ["a b"]), lm.train_model(empty(spark))).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0)
    assert lm.score(empty(spark), lm.train_model(documents(spark, ["a"]))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1 << 64 - 1), st.integers(0, 300)), min_size=1, max_size=200).map(lambda x: sorted(set(x))), st.lists(st.integers(0, 400), max_size=20))
def test_elias_fano(values, asked):
    v = np.array(values, dtype=np.uint64)
    seq, end = lm.EliasFano.at(np.frombuffer(lm.EliasFano.encode(v), dtype=np.uint8), 0)
    assert end == len(lm.EliasFano.encode(v))
    assert seq.get(np.arange(len(v))).tolist() == values
    q = np.array([*values, *asked, *[x + 1 for x in values]], dtype=np.uint64)
    k, same = seq.find(q, np.zeros(len(q)), np.full(len(q), len(v)))
    assert k.tolist() == np.searchsorted(v, q).tolist() and same.tolist() == np.isin(q, v).tolist()


def test_lm_asks_each_shard_once_for_many_batches(spark, monkeypatch):
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(1, 30)) for i in range(40)] + ["", "unseen w1 w2"]
    model = lm.train_model(documents(spark, texts[:40]))
    words, grams, calls = lm.Words(model.words), lm.Ngrams(model.ngrams, model.per, model.n, model.order), []
    level = lm.Level.score
    monkeypatch.setattr(lm.Level, "score", lambda self, *a: calls.append(1) or level(self, *a))

    def scores(asked: int) -> np.ndarray:
        monkeypatch.setattr(lm, "ASKED", asked)
        out = []
        for hashes, sizes in lm.together(lm.token_hashes([t]) for t in texts):
            ids, counts = words.of(hashes)
            out.append(grams.score(ids, sizes, (counts + 0.5) / (model.tokens + 0.5 * (model.n + 1))))
        return np.concatenate(out)

    single = scores(1)
    one_by_one = len(calls)
    calls.clear()
    assert (scores(1 << 20) == single).all() and len(calls) <= len(grams.open) * 2 < one_by_one


# --- 10 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts(spark, name):
    texts = ODD + ["  lead", "trail  ", " ", "  ", "a  b", "<s> </s> <unk>", "nul\0x", "🙂🙂 ﬁ Ａ"] + [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    got = token_counts.count_tokens(documents(spark, texts).withColumn("n_bytes", common.F.lit("own")), queries.tokenizer(name), limit=100).orderBy("doc_id").collect()
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer(name))
        want = [len(sp.encode(t or "")) for t in texts]
    else:
        from tokenizers import Tokenizer

        t_ = Tokenizer.from_file(queries.tokenizer(name))
        want = [len(t_.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got] == [(len((t or "").encode()), n, n > 100) for t, n in zip(texts, want, strict=True)]
    assert token_counts.count_tokens(empty(spark), queries.tokenizer(name)).count() == 0


# --- pipeline --------------------------------------------------------------------------------------


def assert_packed(texts, rows):
    """rows are the pieces of texts (a list for each doc_id) by the library's ids, and fill sequences without a gap."""
    from tokenizers import Tokenizer

    t, want, seqs = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json")), Counter(), {}
    for d, several in texts.items():
        for text in several:
            ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
            first, at = len(ids) % 2048 or 2048, 0
            for k, end in enumerate(range(first, len(ids) + 1, 2048)):
                want[(d, k, at, end - at, zlib.crc32(np.array(ids[at:end], dtype="<u4").tobytes()))] += 1
                at = end
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *[n for _, n in s][:-1]]).tolist() and sum(n for _, n in s) <= 2048


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline

    kept = ["language_id", "near_dedup", "decontaminate"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty(spark), SF)
        assert out.count() == 0 and (name not in kept or out.columns == empty(spark).columns)
    text = spark.read.parquet(f"{SF}/documents.parquet").select("text").orderBy("doc_id").first()[0]
    rows = [(None, text), (None, text), (3, text), (3, text), (4, None), (5, ""), (6, "some " * 40_000 + "end")]
    odd = spark.createDataFrame([(i, t, "en", "s", 0, "own", 1, True, 2, "x") for i, t in rows], DOCS + ", tk string, n long, contaminated boolean, row_number long, piece string")
    stages = dict(corpus_pipeline.STAGES)
    count = lambda d: Counter((r["doc_id"], r["text"]) for r in d.collect())
    assert count(stages["language_id"](spark, odd, SF)) == Counter(r for r in rows if r[1])
    assert stages["language_id"](spark, odd.withColumn("lang", common.F.lit(None).cast("string")), SF).count() == 0
    assert count(stages["near_dedup"](spark, odd, SF)) == Counter({(3, text): 1, (4, None): 1, (5, ""): 1, rows[6]: 1})
    assert count(stages["decontaminate"](spark, odd, SF)) == Counter(rows)
    for name in kept:
        assert stages[name](spark, odd, SF).columns == odd.columns
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    assert_packed(texts, stages["pack"](spark, odd, SF).collect())


def test_workers_keep_no_other_operators_caches(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.pack(spark, docs, SF).count()
    neardup.near_duplicates(docs).count()

    def look(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"held": [",".join(common._cache)]})

    time.sleep(common.IDLE + 3)
    held = {r["held"] for r in spark.range(0, 200, 1, 200).mapInArrow(look, "held string").distinct().collect()}
    assert held == {""}
    common.cached("one", "a", lambda: [1])
    common.cached("two", "b", lambda: [2])
    assert list(common._cache) == ["two"]
    common.release()
    assert not common._cache


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, SF), name)
        steps[name] = (docs, out)
        docs = out
    ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    for n in names[:-1]:
        assert steps[n][1].columns == steps[n][0].columns and ids(steps[n][1]) <= ids(steps[n][0])
    before, after = steps["near_dedup"]
    rows = {r["doc_id"]: r["text"] for r in before.collect()}
    order = sorted(rows)
    groups = brute_groups([rows[i] for i in order], 5)
    assert ids(after) == {order[i] for i, (_, g) in enumerate(groups) if g == i}
    before, after = steps["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r["text"] for r in before.collect()}
    assert ids(after) == {i for (i, t), b in zip(rows.items(), brute_decontam(list(rows.values()), items), strict=True) if b[1] == 0}
    assert ids(steps["pack"][1]) == ids(after)
    before, after = steps["language_id"]
    model = langid.fit(before)
    told = {r["doc_id"]: (model.infer(r["text"]) or [("und", 0.0)])[0] for r in before.collect()}
    assert ids(after) == {i for i, (lang, share) in told.items() if lang != "und" and share >= corpus_pipeline.LEAST_SHARE}
    before, after = steps["pack"]
    assert_packed({r["doc_id"]: [r["text"]] for r in before.collect()}, after.collect())
    mixed = documents(spark, [None, "", "12 34", *[r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()]])
    assert ids(corpus_pipeline.language(spark, mixed, SF)) == set(range(3, 43))


def test_pipeline_stages_judge_rows_without_ids_of_their_own(spark):
    import corpus_pipeline

    passage = spark.read.parquet(f"{SF}/benchmark.parquet").select("text").orderBy("item_id").first()[0]
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "bad " + passage), (None, "clean words of a null id"), (1, "bad " + passage), (1, "clean words of a repeated id"), (2, "bad"), (3, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminate(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted((r for r in rows if passage not in (r[1] or "")), key=str)

    rows = [(None, near), (None, near + " x"), (None, near), (None, "of its own"), (7, near), (7, "other text of seven"), (7, "other text of seven"), (9, "other text of seven"), (5, near + " y"), (8, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    want = [(5, near + " y"), (7, "other text of seven"), (None, "of its own"), (8, None), (None, None)]
    assert out.columns == docs.columns and sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=str) == sorted(want, key=str)
    alone = spark.createDataFrame([(None, near, "en", "s", 0), (None, near + " x", "en", "s", 0)], DOCS)
    assert corpus_pipeline.near_dedup(spark, alone, SF).count() == 1
