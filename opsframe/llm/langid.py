"""Language mixtures of documents from n-gram likelihoods.

A document's n-grams are drawn from a mixture of languages. Expectation-maximisation estimates the
shares; the set of languages starts with the most likely one and grows by the language that raises
the likelihood most, as long as the gain exceeds a penalty that grows with log(n).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Buckets of byte trigrams in a language's table: the bound of the model is 4 * BUCKETS bytes a language.
BUCKETS = 1 << 18
#: Distinct labelled texts a language, at most, that are enough to fit it; values of the hash that draws them.
TRAIN_DOCS, DRAWS = 3000, 1 << 52
#: Additive smoothing, weight of the penalty, least share of a language in a set, EM steps.
ALPHA, PENALTY, LEAST_SHARE, STEPS = 0.2, 6.0, 0.05, 12
#: Trigrams that EM looks at in one block; a longer text is summed over blocks, all of it.
BLOCK = 1 << 16


def grams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text, its white space collapsed."""
    raw = np.frombuffer(f" {' '.join(text.lower().split())} ".encode(), dtype=np.uint8).astype(np.uint32)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


class Mixture:
    """table: float32, a row per bucket and a column per language, probabilities."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        total = counts.sum(axis=1, keepdims=True)
        self.langs = langs
        self.p = np.ascontiguousarray(((counts + ALPHA) / (total + ALPHA * BUCKETS)).T.astype(np.float32))
        self.log = np.log(self.p)

    def em(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Shares and log likelihood; p: distinct trigrams by languages of the set, n: how often each occurs."""
        share, total = np.full(p.shape[1], 1 / p.shape[1], dtype=np.float32), n.sum()
        for _ in range(STEPS):
            share = share * (p.T @ (n / (p @ share))) / total
        return share, float(n @ np.log(p @ share))

    def infer(self, text: str) -> list[tuple[str, float]]:
        """Languages and their shares, largest first; none without a letter."""
        if not self.langs or not any(c.isalpha() for c in text):
            return []
        g = grams(text)
        if len(g) > BLOCK:
            g, n = np.unique(g, return_counts=True)
            n = n.astype(np.float32)
        else:
            n = np.ones(len(g), dtype=np.float32)
        p = self.p[g]
        single = n @ self.log[g]
        chosen, shares = [int(single.argmax())], np.ones(1, dtype=np.float32)
        total, best = n.sum(), float(single.max())
        while len(chosen) < len(self.langs):
            # the slope of the likelihood at share 0; the likelihood is concave, so without a slope there is no gain
            slope = (n / (p[:, chosen] @ shares)) @ p / total
            slope[chosen] = 0
            k = int(slope.argmax())
            if slope[k] <= 1.0:
                break
            new, value = self.em(p[:, [*chosen, k]], n)
            # neighbouring trigrams share bytes: a third of the gain counts
            if (value - best) / 3 <= 0.5 * PENALTY * np.log(total + 1) or new.min() < LEAST_SHARE:
                break
            chosen, shares, best = [*chosen, k], new, value
        order = sorted(zip([self.langs[k] for k in chosen], shares.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
        return [(k, min(1.0, max(0.0, s))) for k, s in order]


def fit(train: DataFrame) -> Mixture:
    """train (text, lang): the tables of the languages, from at most TRAIN_DOCS distinct texts each; rows with a null are left out.

    The sample has the texts of a language with the least hashes, whatever the order of the rows. Copies count once.
    """
    small_batches(train.sparkSession)
    rows = train.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null")
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("text"), F.lit(DRAWS)))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()}
    langs = sorted(sizes)
    counts = np.zeros((len(langs), BUCKETS), dtype=np.float64)
    if langs:
        # twice as many as needed by the estimated number of texts, then exactly the least ones of these
        ample = F.create_map(*[F.lit(x) for k in langs for x in (k, int(DRAWS * min(1.0, 2 * max(TRAIN_DOCS, 100) / sizes[k])))])
        some = rows.where(F.col("draw") < ample[F.col("lang")])
        place = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
        least = some.select("lang", "draw").distinct().withColumn("place", place).where(F.col("place") <= TRAIN_DOCS)
        last = F.create_map(*[F.lit(x) for r in least.groupBy("lang").agg(F.max("draw").alias("last")).collect() for x in (r["lang"], r["last"])])
        some = some.where(F.col("draw") <= last[F.col("lang")]).groupBy("lang", "draw").agg(F.first("text").alias("text"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: dict[str, np.ndarray] = {}
            for b in batches:
                for text, lang in zip(b["text"], b["lang"], strict=True):
                    seen.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    seen[lang] += np.bincount(grams(text), minlength=BUCKETS)
            for lang, c in seen.items():
                g = np.flatnonzero(c)
                yield pd.DataFrame({"lang": lang, "gram": g, "n": c[g]})

        made = some.mapInPandas(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
        counts[[langs.index(x) for x in made["lang"]], made["gram"].to_numpy(dtype=int)] = made["n"]
    return Mixture(langs, counts)


def detect(docs: DataFrame, model: Mixture, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (largest share, or `und`), score (its share) and languages (all shares).

    `und` with score 0 where the text is null or has no letter, or nothing was learned. Ties go to the
    first language by name. Repeated rows stay; own columns of these names are replaced. Only the text counts.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<lang: string, share: double>>")
    def mixture(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[{"lang": k, "share": s} for k, s in sent.value.infer(t)] if t else [] for t in b])

    kept = docs.drop("lang_pred", "score", "languages")
    out = kept.withColumn("languages", mixture(F.col(text_col).cast("string")))
    top = F.get(F.col("languages"), F.lit(0))
    return out.withColumn("lang_pred", F.coalesce(top["lang"], F.lit("und"))).withColumn("score", F.coalesce(top["share"], F.lit(0.0)))
