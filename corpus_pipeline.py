"""From documents to packed sequences: language, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; run() writes each stage's result
as Parquet to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm import decontam, langid, neardup, packing
from opsframe.llm.common import materialize, table, text_key
from opsframe.llm.queries import tokenizer

#: Least share of a document's main language.
LEAST_SHARE = 0.5
#: Keys of dropped rows that are broadcast at most, 16 bytes each.
BROADCAST_ROWS = 1 << 20


def _without(docs: DataFrame, dropped: DataFrame, keys: dict[str, Column], name: str, native: bool = False) -> DataFrame:
    """docs without the rows whose keys (columns of dropped: what they are in docs) are a row of dropped, nulls being equal.

    Texts move only where the rows of dropped are too many to broadcast. native: without Python workers.
    """
    dropped = materialize(dropped.select(*[F.col(k).alias(f"dropped_{k}") for k in keys]).distinct(), name, 0, native)
    same = reduce(and_, [of.eqNullSafe(F.col(f"dropped_{k}")) for k, of in keys.items()])
    return docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, same, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the labels teach, all of their columns and copies, whatever their doc_id.

    Null or empty texts, texts without a letter and texts without a main language go; so does every row where
    no row has a label. An empty table stays empty.
    """
    out = langid.detect(docs, langid.fit(docs))
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, by five-word shingles: the smallest doc_id's; of one doc_id, the least hash of the text's.

    A null doc_id comes last. Rows of one doc_id and text are one; with different texts they are compared each by itself.
    Null texts and texts without words are copies of nothing. An empty table stays empty.
    """
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        groups = neardup.near_duplicates(docs)
        return _without(docs, groups.where("not kept"), {"doc_id": F.col("doc_id")}, "dropped")
    # ids don't tell the rows apart: number them in the order that says which one stays
    one = docs.withColumn("text_key", text_key()).dropDuplicates(["doc_id", "text_key"])
    rows = materialize(one.orderBy(F.asc_nulls_last("doc_id"), "text_key").withColumn("row_number", F.monotonically_increasing_id()), "rows")
    groups = neardup.near_duplicates(rows.select(F.col("row_number").alias("doc_id"), "text"))
    return _without(rows, groups.where("not kept"), {"doc_id": F.col("row_number")}, "dropped").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Rows are judged by their own text, also where a doc_id is null or repeats.

    Null and empty texts have no passage and stay; repeated rows stay or go together; without items all rows stay.
    """
    found = decontam.by_text(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"), {"doc_id": F.col("doc_id"), "tk": text_key()}, "contaminated", native=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, with their sequences and offsets: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row gives its pieces, repeated ones and those of null ids too; a null text is the end token alone. No row gives no piece.
    """
    n = docs.count()
    return packing.pack(packing.encode_digests(docs, tokenizer("byte_bpe_50k.json"), rows=n), rows=n, stored=True)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: No SQL says what language a text is in, nor packs best-fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
