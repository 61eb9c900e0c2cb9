"""Alert rules as people write them, brought to the form that the evaluators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import log_filters as lf

#: Kinds, and other names of them.
KINDS = {
    "metric_threshold": ["threshold", "host_threshold", "host_metric", "host_metric_threshold"],
    "metric_raw": ["promql", "prom_query", "raw_promql", "raw_metric", "custom_metric"],
    "metric_anomaly": ["anomaly", "metric_baseline", "baseline"],
    "metric_forecast": ["forecast", "predict", "prediction"],
    "metric_burn_rate": ["burn_rate", "slo_burn_rate"],
    "log_search": ["log_error", "log_keyword"],
    "log_match": ["log", "log_regex"],
    "log_volume": ["log_rate", "log_count", "log_spike"],
    "trace_latency": ["latency", "trace_p95", "trace_p99"],
    "trace_error_rate": ["error_rate", "trace_errors", "trace_error"],
}
#: Keys that tell a rule's kind, the first kind that has a key of each of its lists is taken.
KIND_KEYS = {
    "log_search": [["keywords", "include_keywords", "exclude_keywords", "filters"]],
    "log_volume": [["stream_selector"], ["ratio_op", "ratio_threshold"]],
    "log_match": [["stream_selector", "line_filter", "filter", "regex", "pattern"]],
    "trace_latency": [["threshold_ms", "latency_ms", "quantile", "operation"]],
    "trace_error_rate": [["threshold_pct", "error_rate_pct", "error_rate_threshold"]],
    "metric_burn_rate": [["sli", "slo", "burns"]],
    "metric_forecast": [["fit_window", "predict_seconds"]],
    "metric_anomaly": [["baseline_window", "baseline_step", "deviation", "method"]],
    "metric_raw": [["expr", "promql", "query", "metric_key", "metric", "metric_name"]],
}
#: By kind, a key and the keys that may stand for it, the first that is there counts; numbers only from numbers.
ALIASES = {
    "metric_raw": {"expr": ["promql", "query"], "metric": ["metric_key", "metric_name"]},
    "metric_anomaly": {"metric": ["metric_key"]},
    "metric_forecast": {"metric": ["metric_key"]},
    "log_search": {"keywords": ["keyword", "line_filter", "filter"]},
    "log_match": {"line_filter": ["filter", "regex", "pattern", "line_regex"]},
    "log_volume": {"line_filter": ["filter", "regex", "pattern", "line_regex"], "ratio_op": ["operator", "op"], "ratio_threshold": ["threshold", "value"]},
    "trace_latency": {"threshold_ms": ["threshold", "latency_ms", "value"]},
    "trace_error_rate": {"threshold_pct": ["threshold", "error_rate_pct", "error_rate_threshold", "value"]},
}
NUMBERS = ["ratio_threshold", "threshold_ms", "threshold_pct"]
#: What a kind's rule has where it says nothing.
DEFAULTS = {
    "metric_anomaly": {"method": "zscore", "baseline_window": "1h", "baseline_step": "5m", "deviation": "3"},
    "metric_forecast": {"fit_window": "1h", "predict_seconds": "21600", "operator": "<="},
    "metric_burn_rate": {"slo": "99.9"},
    "log_search": {"window": "5m", "operator": ">=", "threshold": "1"},
    "log_match": {"window": "5m", "operator": ">=", "threshold": "1"},
    "log_volume": {"window": "5m", "ratio_op": ">=", "ratio_threshold": "2"},
    "trace_latency": {"quantile": "p95", "window": "5m", "threshold_ms": "500"},
    "trace_error_rate": {"window": "5m", "operator": ">=", "threshold_pct": "1"},
    "metric_threshold": {"window": "5m", "aggregator": "avg"},
}
#: Other names of operators.
OPERATORS = {"gt": ">", "gte": ">=", "ge": ">=", "=>": ">=", "lt": "<", "lte": "<=", "le": "<=", "=<": "<=", "eq": "==", "=": "==", "ne": "!=", "neq": "!="}
#: Host metrics, and other names of them.
METRICS = {
    "cpu_pct": ["cpu", "cpu_percent", "cpu_percentage", "cpu_usage", "cpu_usage_percent", "cpu_used_percent", "cpu_used_pct", "cpu_util", "cpu_utilization"],
    "mem_pct": ["mem", "memory", "memory_pct", "mem_percent", "memory_percent", "mem_usage", "memory_usage", "mem_usage_percent", "memory_usage_percent", "mem_used_percent", "memory_used_percent"],
    "disk_used_pct": ["disk", "disk_pct", "disk_percent", "disk_usage", "disk_usage_percent", "disk_used", "disk_used_percent", "filesystem_usage", "filesystem_used_percent"],
    "disk_avail_bytes": ["disk_free", "disk_available", "disk_avail", "disk_available_bytes", "filesystem_available", "filesystem_avail_bytes"],
    "load1": ["load", "load_1", "loadavg", "load_avg"],
    "load5": ["load_5"],
    "load15": ["load_15"],
    "net_rx_bps": ["net_rx", "rx", "rx_bps", "network_rx", "network_receive", "network_receive_bps", "network_in", "net_in"],
    "net_tx_bps": ["net_tx", "tx", "tx_bps", "network_tx", "network_transmit", "network_transmit_bps", "network_out", "net_out"],
}
#: Series whose name anywhere in a metric's text tells it.
METRICS_BY_SERIES = {"node_cpu_seconds_total": "cpu_pct", "node_filesystem_avail_bytes": "disk_avail_bytes", "node_filesystem_free_bytes": "disk_avail_bytes"}
_THRESHOLDS = ["threshold", "threshold_pct", "threshold_ms", "value"]
_NONE = "map<string,string>"


def _table(values: dict[str, str]) -> Column:
    return F.expr("map(" + ",".join(f"'{k}','{v}'" for k, v in values.items()) + ")")


def _snake(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")


def _first(spec: Column, keys: list[str]) -> Column:
    return F.coalesce(*[spec[k] for k in keys])


def _number(spec: Column, keys: list[str]) -> Column:
    """The first of the keys' values that is a number, as text."""
    return F.coalesce(*[F.when(spec[k].try_cast("double").isNotNull(), F.trim(spec[k])) for k in keys])


def _put(spec: Column, values: dict[str, Column | str]) -> Column:
    """spec with the values that are not null in place of its own."""
    new = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v) if isinstance(v, str) else v)]), lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(spec, lambda k, _: ~F.map_contains_key(new, k)), new)


def _drop(spec: Column, *keys: str) -> Column:
    return F.map_filter(spec, lambda k, _: ~k.isin(*keys))


def sign_of(op: Column) -> Column:
    """An operator by its sign; > where it is none."""
    signs = _table(OPERATORS | {s: s for s in set(OPERATORS.values())})
    return F.coalesce(signs[F.lower(F.trim(op))], F.lit(">"))


def metric_of(name: Column) -> Column:
    """A host metric by its own name; other names as they are."""
    out = F.coalesce(_table({a: m for m, others in METRICS.items() for a in [m, *others]})[_snake(name)], F.trim(name))
    for series, metric in reversed(METRICS_BY_SERIES.items()):
        out = F.when(_snake(name).contains(series), metric).otherwise(out)
    return out


def kind_of(spec: Column, kind: Column) -> Column:
    """The given kind by its own name, or the one whose keys the spec has; empty if none fits."""
    out = F.lit("")
    for name, lists in reversed(KIND_KEYS.items()):
        has = [F.arrays_overlap(F.map_keys(spec), F.array(*map(F.lit, keys))) for keys in lists]
        out = F.when(has[0] if len(has) == 1 else has[0] & has[1], name).otherwise(out)
    given = _snake(F.coalesce(kind, F.lit("")))
    return F.when(given != "", F.coalesce(_table({a: k for k, others in KINDS.items() for a in others})[given], given)).otherwise(out)


def percent(c: Column) -> Column:
    """A share of at most 1 as percent."""
    return F.when((c > 0) & (c <= 1), c * 100).otherwise(c)


def _text(c: Column) -> Column:
    """A number without needless digits."""
    return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))


def log_rules(rules: DataFrame) -> DataFrame:
    """Rules on log lines with stream_selector and line_filter out of what they have: a query, a chain, or a filter with labels in it."""
    spec, own = F.col("spec"), F.col("kind").isin("log_match", "log_volume")
    fallback = {"log_match": lf.JOURNAL, "log_volume": lf.EVERYTHING}
    out = rules.withColumn("_q", F.when(own, lf.split_query(spec["query"])))
    out = out.withColumn("_f", F.when(F.col("_q").isNotNull(), lf.line_filter(F.col("_q.filter"))))
    both = lf.shown(lf.first_of_each(F.concat(lf.matchers(F.col("_q.selector")), F.col("_f.matchers"))))
    selector = F.when(F.size("_f.matchers") > 0, both).otherwise(F.col("_q.selector"))
    pattern = F.when(F.col("_f.pattern") != "", F.col("_f.pattern"))
    split = _put(_drop(spec, "query"), {"stream_selector": F.coalesce(spec["stream_selector"], selector), "line_filter": F.coalesce(spec["line_filter"], pattern)})
    out = out.withColumn("spec", F.when(F.col("_q").isNotNull(), split).otherwise(spec))
    out = out.withColumn("_f", F.when(own, lf.line_filter(_first(spec, ["line_filter", *ALIASES["log_match"]["line_filter"]]))))
    m = F.lit(None)
    for kind, other in fallback.items():
        m = F.when(F.col("kind") == kind, lf.stream_matchers(spec["stream_selector"], other)).otherwise(m)
    out = out.withColumn("_m", m)
    pattern = F.when(F.col("_f.pattern") != "", F.col("_f.pattern"))
    whole = _put(_drop(spec, "line_filter"), {"stream_selector": lf.shown(lf.first_of_each(F.concat("_m", "_f.matchers"))), "line_filter": pattern})
    return out.withColumn("spec", F.when(own, whole).otherwise(spec)).drop("_q", "_f", "_m")


def metric_rules(rules: DataFrame) -> DataFrame:
    """Rules on metrics: an expression gets its comparison, a host metric with a threshold is a threshold rule, a forecast of the
    share of free disk is one of the used share, ranges of a service level's expression are its window."""
    spec, kind = F.col("spec"), F.col("kind")
    op, limit = _first(spec, ["operator", "op", "comparison"]), _number(spec, _THRESHOLDS)
    host = (kind.isin("metric_raw", "")) & spec["expr"].isNull() & metric_of(spec["metric"]).isin(list(METRICS)) & op.isNotNull() & limit.isNotNull()
    threshold = _put(F.create_map().cast(_NONE), {"metric": metric_of(spec["metric"]), "operator": sign_of(op), "threshold": _text(limit.cast("double"))})
    number = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
    expr = F.coalesce(F.trim(spec["expr"]), F.when(spec["metric"].rlike("^[a-zA-Z_:][a-zA-Z0-9_:]*$"), spec["metric"]))
    compared = F.when(expr.rlike(rf"(?s)(>=|<=|==|!=|>|<)\s*{number}\s*$"), expr).when(
        op.isNotNull() & limit.isNotNull(), F.concat(F.lit("("), expr, F.lit(") "), sign_of(op), F.lit(" "), _text(limit.cast("double")))).otherwise(F.trim(spec["expr"]))
    # a forecast of free by size
    free = F.coalesce(_first(spec, ["expr", "promql", "query"]), F.lit(""))
    share = percent(_number(spec, ["threshold", "threshold_pct", "value"]).cast("double"))
    disk = (kind == "metric_forecast") & free.rlike("(?i)node_filesystem_size_bytes") & free.rlike("(?i)node_filesystem_(avail|free)_bytes") & free.contains("/") & share.between(0, 100)
    named = F.transform(F.regexp_extract_all(free, F.lit(r"node_filesystem_(?:avail|free|size)_bytes\s*(\{[^}]*\})?"), F.lit(1)), lambda s: F.regexp_extract_all(s, F.lit(r'([A-Za-z_]\w*="[^"]*")'), F.lit(1)))
    common = F.array_join(F.array_sort(F.aggregate(named, F.get(named, F.lit(0)), lambda a, b: F.array_intersect(a, b))), ",")
    turned = _table({"<": ">", "<=": ">=", ">": "<", ">=": "<="})[sign_of(spec["operator"])]
    used = _put(_drop(spec, "expr", "promql", "query"), {
        "metric": "disk_used_pct", "operator": F.coalesce(turned, sign_of(spec["operator"])), "threshold": _text(F.lit(100.0) - share), "selector": F.coalesce(spec["selector"], F.when(common != "", common)),
    })
    sli = F.when(spec["sli"].contains("$window"), F.trim(spec["sli"])).otherwise(F.regexp_replace(F.trim(spec["sli"]), r"\[\d+(?:ms|s|m|h|d|w|y)\]", r"[\$window]"))
    slo = percent(spec["slo"].try_cast("double"))
    level = _put(spec, {"sli": sli, "slo": F.when(spec["slo"].try_cast("double") <= 1, slo.cast("string"))})
    metric = _put(spec, {"metric": metric_of(spec["metric"])})
    # first is whether a rule becomes a threshold rule, as the spec decides it
    return rules.withColumn("_host", F.coalesce(host, F.lit(False))).withColumn("spec", F.when(F.col("_host"), threshold).when(F.coalesce(disk, F.lit(False)), used).when(
        kind == "metric_raw", _put(spec, {"expr": compared})).when(kind == "metric_burn_rate", level).when(kind.isin("metric_anomaly", "metric_forecast"), metric).otherwise(spec)).withColumn(
        "kind", F.when(F.col("_host"), "metric_threshold").otherwise(kind)).drop("_host")


def normalise(rules: DataFrame) -> DataFrame:
    """rules with kind and spec (a map of strings) in the form of evaluators: kinds, keys, operators and metrics by their own names,
    kinds inferred, log queries split into selector and line filter, missing keys at their defaults, shares as percent.

    Blank values are none, and so is a null spec or kind. Keys that no rule knows stay, other columns too; names that begin with _q, _f, _m or _host are taken.
    """
    spec = F.map_filter(F.coalesce("spec", F.create_map().cast(_NONE)), lambda _, v: F.trim(v) != "")
    out = rules.withColumn("spec", spec)
    out = out.withColumn("kind", kind_of(F.col("spec"), F.col("kind")))
    out = log_rules(out)
    spec, kind = F.col("spec"), F.col("kind")
    renamed = spec
    for name, keys in ALIASES.items():
        new = {k: F.coalesce(_number(spec, [k, *others]) if k in NUMBERS else spec[k], _number(spec, others) if k in NUMBERS else _first(spec, others)) for k, others in keys.items()}
        renamed = F.when(kind == name, _put(spec, new)).otherwise(renamed)
    out = out.withColumn("spec", F.when(kind == "", _put(spec, {"metric": _first(spec, ["metric", "metric_key", "metric_name"])})).otherwise(renamed))
    out = metric_rules(out)
    given = F.create_map().cast(_NONE)
    for name, values in DEFAULTS.items():
        given = F.when(F.col("kind") == name, _table(values)).otherwise(given)
    missing = F.map_filter(given, lambda k, _: ~F.map_contains_key("spec", k))
    out = out.withColumn("spec", F.map_concat("spec", missing))
    return out.withColumn("spec", F.transform_values("spec", lambda k, v: F.when(k.isin("operator", "ratio_op"), sign_of(v)).otherwise(v)))
