"""Agent runs and sessions, graphs, documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.operators import documents as dc
from opsframe.operators import graph as gr
from opsframe.operators import runs
from opsframe.sources.tables import micros, read

from .registry import query


def steps(spark, sf):
    c = read(spark, sf, "conversations")
    return c.withColumn("tokens", F.when(F.length("text") % 11 != 0, F.length("text")))


_TOKENS = "CASE WHEN length(text) % 11 <> 0 THEN length(text) END"


@query("a25_usage_null_propagation", f"SELECT conv_id, CASE WHEN count({_TOKENS}) = count(*) THEN sum({_TOKENS})::BIGINT END AS tokens, count(text) > count(DISTINCT text) AS conflict FROM conversations GROUP BY conv_id")
def a25(spark, sf):
    return steps(spark, sf).groupBy("conv_id").agg(runs.total("tokens").alias("tokens"), (F.count("text") > F.count_distinct("text")).alias("conflict"))


@query("a26_run_build", "SELECT conv_id, count(*) AS steps, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, max(turn) AS last FROM conversations GROUP BY conv_id")
def a26(spark, sf):
    return steps(spark, sf).groupBy("conv_id").agg(F.count(F.lit(1)).alias("steps"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.max("turn").alias("last"))


@query("a27_session_rollup", "SELECT conv_id, arg_min(text, turn) AS first_input, arg_max(text, turn) AS last_output, count(*) AS steps FROM conversations GROUP BY conv_id")
def a27(spark, sf):
    return runs.roll_up(steps(spark, sf), "conv_id", "turn", "text", "text", "role", "tokens").select("conv_id", "first_input", "last_output", "steps")


@query("a28_facets", "SELECT DISTINCT 'role' AS facet, role AS value FROM conversations UNION SELECT DISTINCT 'parity', (turn % 2)::VARCHAR FROM conversations")
def a28(spark, sf):
    pairs = F.array(F.struct(F.lit("role").alias("facet"), F.col("role").alias("value")), F.struct(F.lit("parity").alias("facet"), (F.col("turn") % 2).cast("string").alias("value")))
    return read(spark, sf, "conversations").select(F.inline(pairs)).distinct()


@query("a29_quality_checks", """WITH i AS (SELECT unnest(list_filter([CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN length(text) > 1000 THEN 'long' END], lambda x: x IS NOT NULL)) AS issue FROM conversations), n AS (SELECT issue, count(*) AS n FROM i GROUP BY issue)
SELECT issue, coalesce(n, 0)::BIGINT AS n, CASE WHEN coalesce(n, 0) = 0 THEN 'ok' WHEN n < 100 THEN 'warning' ELSE 'bad' END AS status FROM (VALUES ('short'), ('long'), ('cycle')) v(issue) LEFT JOIN n USING (issue)""")
def a29(spark, sf):
    found = F.array_compact(F.array(F.when(F.length("text") < 100, "short"), F.when(F.length("text") > 1000, "long")))
    n = read(spark, sf, "conversations").select(F.explode(found).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([("short",), ("long",), ("cycle",)], "issue string")
    out = names.join(n, "issue", "left").select("issue", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("status", F.when(F.col("n") == 0, "ok").when(F.col("n") < 100, "warning").otherwise("bad"))


_EDGES = """e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'depends_on' AS type FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'deployed_on' FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'routes_to' ELSE 'contains' END FROM customer)"""


def relations(spark, sf):
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = read(spark, sf, "nation").select(s("n", "n_nationkey").alias("src"), s("r", "n_regionkey").alias("dst"), F.lit("depends_on").alias("type"))
    u = read(spark, sf, "supplier").select(s("s", "s_suppkey").alias("src"), s("n", "s_nationkey").alias("dst"), F.lit("deployed_on").alias("type"))
    c = read(spark, sf, "customer").select(s("c", "c_custkey").alias("src"), s("n", "c_nationkey").alias("dst"), F.when(F.col("c_custkey") % 2 == 0, "routes_to").otherwise("contains").alias("type"))
    return n.unionByName(u).unionByName(c)


@query("g1_blast_radius", f"""WITH RECURSIVE {_EDGES}, p AS (SELECT src AS via, dst AS node, type FROM e WHERE type IN ('depends_on', 'deployed_on', 'routes_to') UNION ALL SELECT dst, src, type FROM e WHERE type IN ('depends_on', 'deployed_on', 'routes_to')),
w(node, hops) AS (SELECT 'n3', 0 UNION SELECT p.node, w.hops + 1 FROM w JOIN p ON p.via = w.node WHERE w.hops < 2), d AS (SELECT node, min(hops) AS hops FROM w GROUP BY node)
SELECT d.node, d.hops, min(row(p.via, p.type))[1] AS via, min(row(p.via, p.type))[2] AS type FROM d JOIN p ON p.node = d.node JOIN d b ON b.node = p.via AND b.hops = d.hops - 1 GROUP BY d.node, d.hops""")
def g1(spark, sf):
    return gr.expand(relations(spark, sf), spark.createDataFrame([("n3",)], "node string"), 2)


@query("g2_node_search", "SELECT s_suppkey AS node, s_name AS name FROM supplier WHERE contains(lower(s_name), '00000001')")
def g2(spark, sf):
    from opsframe.operators.select import like_any

    return read(spark, sf, "supplier").where(like_any(["s_name"], "00000001")).select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"))


@query("g2_degrees", f"""WITH {_EDGES}, x AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT node, sum(o)::BIGINT AS "out", sum(i)::BIGINT AS "in" FROM x GROUP BY node""")
def g2b(spark, sf):
    return gr.neighbours(relations(spark, sf))


@query("g3_relation_validity", f"WITH {_EDGES}, x AS (SELECT * FROM e UNION ALL SELECT 'n1', 'n1', 'depends_on' UNION ALL SELECT 'n2', 'n3', 'likes'), y AS (SELECT *, count(*) OVER (PARTITION BY src, type) AS k FROM x), z AS (SELECT src, dst, type, CASE WHEN type = 'likes' THEN 'unknown_type' WHEN src = dst THEN 'loop' WHEN type = 'depends_on' AND k > 1 THEN 'not_unique' END AS reason FROM y) SELECT * FROM z WHERE reason IS NOT NULL")
def g3(spark, sf):
    more = spark.createDataFrame([("n1", "n1", "depends_on"), ("n2", "n3", "likes")], "src string, dst string, type string")
    return gr.invalid(relations(spark, sf).unionByName(more), ["depends_on"])


@query("g4_deployment_edges", "SELECT DISTINCT event_type AS service, user_id AS device FROM events WHERE epoch_us(ts) > 1704067200000000 + 20 * 86400000000::BIGINT EXCEPT SELECT event_type, user_id FROM events WHERE epoch_us(ts) <= 1704067200000000 + 10 * 86400000000::BIGINT")
def g4(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("service"), F.col("user_id").alias("device"), micros("ts").alias("t"))
    t0, day = 1_704_067_200_000_000, 86_400_000_000
    now, before = e.where(F.col("t") > t0 + 20 * day), e.where(F.col("t") <= t0 + 10 * day)
    return now.select("service", "device").distinct().join(before.select("service", "device"), ["service", "device"], "left_anti")


@query("g5_cluster_scope", "SELECT DISTINCT r_name AS cluster, s_suppkey AS device FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def g5(spark, sf):
    r, n, s = (read(spark, sf, t) for t in ("region", "nation", "supplier"))
    return r.join(n, r.r_regionkey == n.n_regionkey).join(s, n.n_nationkey == s.s_nationkey).select(F.col("r_name").alias("cluster"), F.col("s_suppkey").alias("device")).distinct()


@query("g6_span_runs", """WITH s AS (SELECT conv_id::VARCHAR AS trace_id, conv_id, turn, printf('%04d', turn) AS span_id, role AS sdk, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations)
SELECT trace_id, span_id, CASE WHEN turn > 0 THEN printf('%04d', turn - 1) END AS parent_span_id, sdk, 'x' AS identity, min(span_id) OVER (PARTITION BY conv_id, island, sdk) AS run_id,
 CASE WHEN turn > 0 AND NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = s.conv_id AND c.turn = s.turn - 1) THEN 'missing_parent' END AS issue FROM s""")
def g6(spark, sf):
    c = read(spark, sf, "conversations")
    s = c.select(F.col("conv_id").cast("string").alias("trace_id"), F.format_string("%04d", "turn").alias("span_id"), F.when(F.col("turn") > 0, F.format_string("%04d", F.col("turn") - 1)).alias("parent_span_id"), F.col("role").alias("sdk"), F.lit("x").alias("identity"))
    return runs.assign_runs(s)


@query("v1_fixed_chunks", """WITH n AS (SELECT doc_id, text, least(greatest(ceil((length(text) - 250) / 2250.0), 1), 256)::INT AS n FROM documents WHERE length(trim(text)) > 0), i AS (SELECT doc_id, text, unnest(range(0, n)) AS k FROM n)
SELECT doc_id, k AS chunk_index, length(substr(text, k * 2250 + 1, 2500)) AS n, md5(substr(text, k * 2250 + 1, 2500)) AS content FROM i""")
def v1(spark, sf):
    d = dc.chunks(read(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", "chunk_index", F.length("content").alias("n"), F.md5("content").alias("content"))


@query("v2_markdown_sections", None)
def v2(spark, sf):
    return dc.split_markdown(read(spark, sf, "documents").select("doc_id", "text"))


@query("v3_filtered_cosine", """WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), v) AS score FROM embeddings, q WHERE label IN (1, 2, 3))
SELECT vec_id, label, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 50""")
def v3(spark, sf):
    e = read(spark, sf, "embeddings")
    row = e.where("vec_id = 0").first()
    return dc.nearest(e if row else e.limit(0), row["embedding"] if row else [], 10, F.col("label").isin(1, 2, 3)).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("v4_grep", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), x AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS text FROM l) SELECT doc_id, line, text FROM x WHERE contains(text, 'icens') ORDER BY doc_id, line LIMIT 200")
def v4(spark, sf):
    return dc.grep(read(spark, sf, "documents"), "icens").select("doc_id", F.col("line").cast("long").alias("line"), "text")


@query("v6_mention_search", """(SELECT 'customer' AS kind, c_custkey::BIGINT AS id, c_name AS name FROM customer WHERE contains(lower(c_name), '7') ORDER BY c_name LIMIT 5) UNION ALL (SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '7') ORDER BY s_name LIMIT 5)
UNION ALL (SELECT 'part', p_partkey, p_name FROM part WHERE contains(lower(p_name), '7') ORDER BY p_name, p_partkey LIMIT 5) UNION ALL (SELECT 'nation', n_nationkey, n_name FROM nation WHERE contains(lower(n_name), '7') ORDER BY n_name LIMIT 5)""")
def v6(spark, sf):
    def kind(t, k, n):
        d = read(spark, sf, t).where(F.lower(n).contains("7")).select(F.lit(t).alias("kind"), F.col(k).cast("long").alias("id"), F.col(n).alias("name"))
        return d.orderBy("name", "id").limit(5)

    return kind("customer", "c_custkey", "c_name").unionByName(kind("supplier", "s_suppkey", "s_name")).unionByName(kind("part", "p_partkey", "p_name")).unionByName(kind("nation", "n_nationkey", "n_name"))


_TAGS = r"regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _entity, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("amp", "&")):
    _TAGS = f"replace({_TAGS}, '&{_entity};', '{_char}')"


@query("s18_html_text", rf"SELECT page_id, trim(regexp_replace({_TAGS}, '\s+', ' ', 'g')) AS text FROM pages")
def s18(spark, sf):
    return read(spark, sf, "pages").select("page_id", dc.html_text(F.col("html")).alias("text"))
