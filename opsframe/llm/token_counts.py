"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the lengths of frequent pre-tokens, broadcast once; tier two encodes
what it lacks and keeps the lengths in a cache of the worker. Nothing is shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cached, small_batches

#: Bounds of the broadcast table and of its sample; they change speed, never a count.
TABLE_SIZE, SAMPLE_DOCS = 1 << 16, 4000
#: Entries of a worker's cache and the longest pre-token it keeps, in characters.
CACHE_SIZE, CACHE_CHARS = 1 << 19, 48


def pre_tokens(text: str) -> list[str]:
    """Runs of spaces with the run of other characters after them, each without its first space; ' ' + text is what they join to."""
    if "  " not in text and text[:1] != " ":
        return text.split(" ")
    return [x[1:] for x in re.findall(r" +[^ ]*", " " + text)]


class PieceCounter:
    """Counts of a sentencepiece model. A pre-token's count doesn't depend on its neighbours when no
    piece has a space mark after another character, the normalizer is the identity, a dummy prefix is
    added and spaces aren't collapsed; otherwise whole texts are encoded."""

    def __init__(self, model: bytes, table: dict[str, int]):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table, self.cache = table, {}
        n = lambda x: len(self.sp.encode(x, num_threads=1))
        self.n = n
        self.single = n("a ") - n("a")
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.split = not any(re.search("[^▁]▁", p) for p in pieces) and n("") == 0 and self.sp.normalize("Ａ  ﬁ ") == "▁Ａ▁▁ﬁ▁"

    def one(self, p: str) -> int:
        if (n := self.cache.get(p)) is None:
            n = self.n(p) if p else self.single
            if len(p) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_SIZE:
                    self.cache.clear()
                self.cache[p] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.split or "▁" in text or "\0" in text:
            return self.n(text)
        get, total = self.table.get, 0
        for p in pre_tokens(text):
            n = get(p)
            total += self.one(p) if n is None else n
        return total


class LibraryCounter:
    """Counts of a tokenizers file: whole texts, as its pre-tokens depend on the file."""

    def __init__(self, spec: bytes, table: dict[str, int]):
        from .bpe import ByteBpe

        self.bpe = ByteBpe(spec)

    def count(self, text: str) -> int:
        return len(self.bpe.encode(text))


def token_counter(docs: DataFrame, tokenizer: str, text_col: str = "text") -> Column:
    """A column of the token counts of docs' whole texts, for use on docs: null text counts 0."""
    spark = docs.sparkSession
    small_batches(spark)
    model = open(tokenizer, "rb").read()
    kind = PieceCounter if tokenizer.endswith(".model") else LibraryCounter
    lengths: dict[str, int] = {}
    if kind is PieceCounter:
        n = docs.count()
        some = docs.select(F.col(text_col).cast("string").alias("t")).where("t is not null")
        some = some.sample(fraction=SAMPLE_DOCS / n, seed=7) if n > SAMPLE_DOCS else some

        def frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: Counter = Counter()
            for b in batches:
                for t in b["t"]:
                    seen.update(p for p in pre_tokens(t) if len(p) <= CACHE_CHARS and "\0" not in p)
                if len(seen) > 8 * TABLE_SIZE:
                    seen = Counter(dict(seen.most_common(4 * TABLE_SIZE)))
            counter = PieceCounter(model, {})
            top = [p for p, _ in seen.most_common(TABLE_SIZE)]
            yield pd.DataFrame({"p": pd.Series(top, dtype=object), "n": pd.Series([counter.one(p) for p in top], dtype="int32")})

        lengths = {r["p"]: r["n"] for r in some.repartition(1).mapInPandas(frequent, "p string, n int").collect()}
    sent = spark.sparkContext.broadcast((model, "\n\0".join(lengths), bytes(min(n, 255) for n in lengths.values())))
    key = uuid.uuid4().hex

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def make() -> PieceCounter | LibraryCounter:
            spec, names, counts = sent.value
            return kind(spec, dict(zip(names.split("\n\0"), counts, strict=True)) if counts else {})

        counter = cached("tokens", key, make)
        for b in batches:
            yield pd.Series([counter.count(t) if t else 0 for t in b], dtype="int64")

    return tokens(F.col(text_col).cast("string"))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """docs' columns but the text, with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null text counts as empty. Repeated rows stay. An own column named n_bytes, n_tokens or over_limit
    is replaced. Counts are those of the library on the whole text without begin, end or added tokens.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("n_bytes", F.octet_length(text).cast("long")).withColumn("n_tokens", token_counter(docs, tokenizer, text_col))
    return out.withColumn("over_limit", F.col("n_tokens") > limit).drop(text_col)
