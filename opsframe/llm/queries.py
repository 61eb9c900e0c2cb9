"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, filter_audit, langid, licenses, lm, neardup, packing, runs, search, suffix, token_counts, warc
from .common import fold, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    return packing.pack(packing.encode_digests(docs, tokenizer("byte_bpe_50k.json"), rows=n), rows=n, stored=True)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id") == 0, F.lit(False))
    model = langid.fit(docs.where(fold("doc_id") != 0))
    out = langid.detect(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "languages")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = search.search(docs, docs.where(F.col("doc_id") % 50 == 0).withColumnRenamed("doc_id", "query_id"))
    return found.withColumn("score", F.round("score", 6))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(more)), ordered=True)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id") == 1, F.lit(False))
    model = lm.train_model(docs.where(~held))
    return lm.score(docs.select("doc_id", held.alias("held_out"), "text"), model)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = runs.periodic_runs(docs)
    best, line = runs.strongest(F.col("runs")), lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (
    op1_best_fit_packing, op2_language_id, op3_topk_search, op4_license_scan, op5_chat_format, op6_decontaminate, op7_minhash_near_dup, op8_warc, op9_lm_score, op10_token_counts,
    op11_periodic_runs, op12_suffix_dedup, op13_filter_audit, pipeline,
)
QUERIES = {f.__name__: f for f in _ALL}
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("text") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_SEARCH_SQL = f"""
WITH w AS (SELECT doc_id, unnest({_WORDS}) AS t FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, t, count(*) AS n FROM w GROUP BY ALL), l AS (SELECT doc_id, sum(n) AS len FROM b GROUP BY doc_id),
g AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(len) FROM l) / (SELECT count(*) FROM documents) AS mean), f AS (SELECT t, count(*) AS df FROM b GROUP BY t),
s AS (SELECT q.doc_id AS query_id, d.doc_id, sum(q.n * ln(1 + (docs - df + 0.5) / (df + 0.5)) * d.n * 2.2 / (d.n + 1.2 * (0.25 + 0.75 * len / mean))) AS score
 FROM b q JOIN b d USING (t) JOIN f USING (t) JOIN l ON l.doc_id = d.doc_id CROSS JOIN g WHERE q.doc_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10
"""

_CONTROL = "<\\\\*s>|<\\\\*/s>|\\[\\\\*INST\\]|\\[\\\\*/INST\\]|<\\\\*<SYS>>|<\\\\*</SYS>>|<\\\\*\\|endoftext\\|>|<\\\\*\\|image\\|>|<\\\\*\\|audio\\|>|<\\\\*\\|document\\|>"
_CHAT_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(9 + length(role) + length(text) + len(regexp_extract_all(text, '{_CONTROL}')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

_WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM m
"""

ORACLE_SQL = {
    "op3_topk_search": _SEARCH_SQL, "op5_chat_format": _CHAT_SQL, "op6_decontaminate": decontam.ORACLE, "op7_minhash_near_dup": neardup.ORACLE, "op8_warc": _WARC_SQL,
    "op11_periodic_runs": runs.ORACLE, "op12_suffix_dedup": suffix.ORACLE, "op13_filter_audit": filter_audit.ORACLE,
}
