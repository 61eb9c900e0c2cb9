"""Knowledge documents: chunks, filtered vector search, extraction and search in text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP, MOST = 2500, 250, 256


def chunks(docs: DataFrame, text: str = "text", size: int = CHUNK, overlap: int = OVERLAP, most: int = MOST) -> DataFrame:
    """docs' other columns with chunk_index and content: `size` characters, the next one starting `overlap` before the end; the last one ends the text. At most `most`."""
    step = size - overlap
    n = F.least(F.greatest(F.ceil((F.length(text) - overlap) / F.lit(step)), F.lit(1)), F.lit(most)).cast("int")
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text), i * step + 1, F.lit(size)))
    keep = [c for c in docs.columns if c != text]
    return docs.where(F.length(F.trim(F.col(text))) > 0).select(*keep, F.posexplode(made).alias("chunk_index", "content"))


def split_markdown(docs: DataFrame, size: int = CHUNK, short: int = 200) -> DataFrame:
    """(doc_id, chunk_index, heading, content): sections by heading, each with its path of headings; short ones join the next, long ones are cut at blank lines, lines, sentences."""

    def cut(text: str) -> list[str]:
        for sep in ("\n\n", "\n", ". "):
            if len(text) <= size:
                return [text]
            parts, out = text.split(sep), []
            for p in parts:
                if out and len(out[-1]) + len(sep) + len(p) <= size:
                    out[-1] += sep + p
                else:
                    out.append(p)
            if all(len(x) <= size for x in out):
                return out
            text = sep.join(out)
        return [text[i : i + size] for i in range(0, len(text), size)]

    def sections(text: str) -> list[tuple[str, str]]:
        path: list[str] = []
        out: list[tuple[str, list[str]]] = [("", [])]
        for line in text.split("\n"):
            level = len(line) - len(line.lstrip("#"))
            if 0 < level <= 6 and line[level : level + 1] == " ":
                path = [*path[: level - 1], line[level:].strip()]
                out.append((" > ".join(path), []))
            else:
                out[-1][1].append(line)
        made = [(h, "\n".join(b).strip()) for h, b in out]
        joined: list[tuple[str, str]] = []
        for h, b in made:
            if joined and len(joined[-1][1]) < short:
                joined[-1] = (joined[-1][0] or h, (joined[-1][1] + "\n" + b).strip())
            elif b or h:
                joined.append((h, b))
        return joined

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, h, c) for d, t in zip(b["doc_id"], b["text"], strict=True) for i, (h, c) in enumerate((h, c) for h, x in sections(t or "") for c in cut(x) if c)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "heading", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_index int, heading string, content string")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest(vectors: DataFrame, query: Sequence[float], k: int, where: Column | None = None, over_fetch: int = 5, most: int = 200) -> DataFrame:
    """The min(5 k, 200) best rows of a filtered cosine search, to be collapsed to k; ties by vec_id. The filter comes first, the sort keeps only the best rows."""
    q = F.array(*[F.lit(float(x)) for x in query])
    some = vectors if where is None else vectors.where(where)
    return some.withColumn("score", cosine(F.col("embedding"), q)).orderBy(F.desc_nulls_last("score"), "vec_id").limit(min(k * over_fetch, most))


def html_text(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments and tags, common entities decoded, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def grep(docs: DataFrame, pattern: str, literal: bool = True, most: int = 200) -> DataFrame:
    """(doc_id, line, text) of lines that match, in order, at most `most`."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    hit = F.col("text").contains(pattern) if literal else F.col("text").rlike(pattern)
    return lines.where(hit).withColumn("line", F.col("line") + 1).orderBy("doc_id", "line").limit(most)


def tail(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, line, text): the last n lines of each."""
    parts = F.split("text", "\n")
    first = F.greatest(F.size(parts) - n, F.lit(0))
    return docs.select("doc_id", first.alias("f"), F.posexplode(F.slice(parts, first + 1, F.lit(n))).alias("k", "text")).select("doc_id", (F.col("f") + F.col("k") + 1).alias("line"), "text")
