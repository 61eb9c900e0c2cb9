"""Agent runs: steps of traces to runs, sessions, usage and quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.functions.scalars import first_of
from opsframe.storage import materialize

#: Attribute keys by the instrumentation that sets them, in order of preference.
MODEL_KEYS = ["gen_ai.response.model", "gen_ai.request.model", "llm.model_name", "langfuse.observation.model.name"]
INPUT_KEYS = ["gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens", "llm.token_count.prompt"]
OUTPUT_KEYS = ["gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens", "llm.token_count.completion"]
KINDS = {"openinference.span.kind": "openinference", "langfuse.observation.type": "langfuse", "langsmith.span.kind": "langsmith"}


def detect_sdk(attributes: str) -> Column:
    out = F.lit(None).cast("string")
    for key, sdk in KINDS.items():
        out = F.when(F.col(attributes)[key].isNotNull(), sdk).otherwise(out)
    return F.when(out.isNull() & F.exists(F.map_keys(attributes), lambda k: k.startswith("gen_ai.")), "otel").otherwise(out)


def usage(attributes: str, keys: Sequence[str]) -> tuple[Column, Column]:
    """(tokens, conflict) from several keys: negative and unreadable numbers don't count, different ones are a conflict."""
    found = F.array(*[F.col(attributes)[k].try_cast("long") for k in keys])
    good = F.array_distinct(F.filter(found, lambda x: x >= 0))
    return F.when(F.size(good) == 1, F.get(good, F.lit(0))), F.size(good) > 1


def adapt(spans: DataFrame) -> DataFrame:
    a = "attributes"
    tokens_in, bad_in = usage(a, INPUT_KEYS)
    tokens_out, bad_out = usage(a, OUTPUT_KEYS)
    return spans.withColumns({"sdk": detect_sdk(a), "model": first_of(MODEL_KEYS, a), "input_tokens": tokens_in, "output_tokens": tokens_out, "usage_conflict": bad_in | bad_out})


def total(column: str) -> Column:
    """A sum that is null if any part is: unknown isn't zero."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(column))


def _ascend(nodes: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """(nodes with up, least, tops; whether some ups are left), by pointer doubling: up is an ancestor twice as far each round.

    least is the smallest span on the way to up, tops the highest ancestor so far of each key, the span itself included.
    A round is one join by (trace, span), so a large trace is many keys; there are as many as log2 of the deepest span's depth.
    """
    own = F.when(F.col("shared"), F.create_map("key", "span_id")).otherwise(F.create_map().cast("map<string,string>"))
    state = nodes.select("trace_id", "span_id", F.col("parent").alias("up"), F.col("span_id").alias("least"), own.alias("tops"))
    far = 1
    while True:
        state = materialize(state, "ascent")
        if state.where("up is not null").isEmpty():
            return state, False
        if far > most:
            return state, True
        above = state.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"), F.col("up").alias("next"), F.col("least").alias("least2"), F.col("tops").alias("tops2"))
        met = state.where("up is not null").join(above, F.col("trace_id").eqNullSafe(F.col("t")) & (F.col("up") == F.col("s")))
        # the higher one of two ancestors of a key stands in the upper part
        tops = F.map_zip_with("tops", "tops2", lambda k, low, high: F.coalesce(high, low))
        moved = met.select("trace_id", "span_id", F.col("next").alias("up"), F.least("least", "least2").alias("least"), tops.alias("tops"))
        state = moved.unionByName(state.where("up is null"))
        far *= 2


def assign_runs(steps: DataFrame) -> DataFrame:
    """steps (trace_id, span_id, parent_span_id, sdk, identity) with run_id and issue.

    A step belongs to the run of its nearest ancestor of the same sdk and identity, else starts one; so its run is its highest
    such ancestor. A missing parent or a cycle is an issue; a cycle is cut at its smallest span. Rows that repeat a span_id have one
    parent, the smallest, and get one issue; a null span_id is a run of its own without a name, a null trace_id is one trace.
    All of it is joins by (trace, span); what a span carries is its ancestors' keys that occur more than once in the trace.
    """
    cols = steps.select("trace_id", "span_id", "parent_span_id", "sdk", "identity")
    cols = cols.withColumn("key", F.to_json(F.struct("sdk", "identity"), {"ignoreNullFields": "false"}))
    one = cols.where("span_id is not null").groupBy("trace_id", "span_id").agg(F.min(F.struct(F.col("parent_span_id").isNull(), "parent_span_id", "key")).alias("x"))
    one = one.select("trace_id", "span_id", F.nullif("x.parent_span_id", F.lit("")).alias("parent"), "x.key")
    keys = one.groupBy("trace_id", "key").agg((F.count(F.lit(1)) > 1).alias("shared"))
    same = lambda a, b: F.col(f"{a}.trace_id").eqNullSafe(F.col(f"{b}.trace_id"))
    nodes = one.alias("o").join(keys.alias("k"), same("o", "k") & (F.col("o.key") == F.col("k.key"))).select("o.*", "shared")
    spans = one.select("trace_id", "span_id")
    nodes = nodes.alias("n").join(spans.alias("p"), same("n", "p") & (F.col("n.parent") == F.col("p.span_id")), "left")
    missing = F.when(F.col("parent").isNotNull() & F.col("p.span_id").isNull(), "missing_parent")
    nodes = materialize(nodes.select("n.trace_id", "n.span_id", F.col("p.span_id").alias("parent"), "key", "shared", missing.alias("issue")), "nodes")
    most = nodes.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
    state, cyclic = _ascend(nodes, most)
    if cyclic:
        # what is left points into cycles, at each of their spans; the way from there is the whole cycle
        ends = state.where("up is not null").select("trace_id", F.col("up").alias("span_id")).distinct()
        cut = ends.alias("e").join(state.alias("s"), same("e", "s") & (F.col("e.span_id") == F.col("s.span_id"))).select(F.col("s.trace_id").alias("t"), F.col("least").alias("c")).distinct()
        nodes = nodes.join(cut, F.col("trace_id").eqNullSafe(F.col("t")) & (F.col("span_id") == F.col("c")), "left")
        nodes = nodes.withColumn("issue", F.when(F.col("c").isNotNull(), "cycle").otherwise(F.col("issue"))).withColumn("parent", F.when(F.col("c").isNull(), F.col("parent"))).drop("t", "c")
        nodes = materialize(nodes, "nodes")
        state, _ = _ascend(nodes, most)
    made = state.alias("s").join(nodes.alias("n"), same("s", "n") & (F.col("s.span_id") == F.col("n.span_id"))).select(
        F.col("n.trace_id").alias("t"), F.col("n.span_id").alias("s"), F.coalesce(F.element_at("tops", F.col("key")), F.col("n.span_id")).alias("run_id"), "issue")
    out = cols.join(made, F.col("trace_id").eqNullSafe(F.col("t")) & (F.col("span_id") == F.col("s")), "left")
    return out.select("trace_id", "span_id", "parent_span_id", "sdk", "identity", "run_id", "issue")


def roll_up(steps: DataFrame, by: str, start: str, text_in: str, text_out: str, model: str, tokens: str) -> DataFrame:
    """A session or run: number of steps, distinct models, tokens, first input and last output."""
    return steps.groupBy(by).agg(
        F.count(F.lit(1)).alias("steps"), F.array_sort(F.collect_set(model)).alias("models"), total(tokens).alias("tokens"),
        F.min_by(text_in, start).alias("first_input"), F.max_by(text_out, start).alias("last_output"),
    )
